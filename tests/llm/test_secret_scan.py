"""Secrets of many shapes planted in documents: what the scan finds, misses and takes by mistake."""

import random

import pytest
from pyspark.sql import functions as F

from pairlight.llm import secrets
from pairlight.llm.common import table

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def planted(r):
    """Text, value and whether it is a secret."""
    rand = lambda n, chars=ALNUM: "".join(r.choice(chars) for _ in range(n))
    word = lambda: r.choice("Harbour Winter Falcon Orange Monday Coffee Dragon Silver".split())
    password = word() + str(r.randrange(10, 99)) + r.choice("!#$&") + rand(2)
    short, long_ = rand(r.randrange(9, 14)) + str(r.randrange(10)) + r.choice("!@#%"), rand(r.randrange(24, 40)) + "7"
    return [
        (f'DB_PASSWORD="{password}"', password, True),
        (f"password: {short}", short, True),
        (f"api_key = '{long_}'", long_, True),
        (f"connect mysql://admin:{short[:-1]}@db.local:3306/shop", short[:-1], True),
        (f"client_secret => {long_};", long_, True),
        ("AKIA" + rand(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), None, True),
        ("ghp_" + rand(36), None, True),
        (f"token = {rand(40, '0123456789abcdef')}", None, True),
        ("password: required", "required", False),
        ("secretary: Margaret", "Margaret", False),
        (f"commit {rand(40, '0123456789abcdef')}", None, False),
        ("token: <your-token>", "<your-token>", False),
        (f"order {rand(16, '0123456789')}", None, False),
        ("key = undefined", "undefined", False),
        ("auth: ${AUTH_TOKEN}", "${AUTH_TOKEN}", False),
        ("see https://host.example:8080/path/index-page-2024.html", None, False),
    ]


@pytest.fixture(scope="module")
def found(spark):
    r = random.Random(5)
    docs = [x["text"] or "" for x in table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()]
    rows, truth = [], {}
    for i, text in enumerate(docs):
        ws = text.split(" ")
        at = r.randrange(len(ws) + 1)
        kinds = planted(r)
        line, value, is_secret = kinds[i % len(kinds)]
        truth[i] = (value or line.split()[-1], is_secret)
        rows.append((i, " ".join([*ws[:at], line, *ws[at:]]), "src0"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = spark.createDataFrame([(i, t, "src0") for i, t in enumerate(docs)], df.schema)
    known = {(x.doc_id, x.candidate) for x in secrets.scan(plain).where("is_secret").collect()}
    return df, truth, secrets.scan(df).collect(), known


def test_recall_and_precision(found):
    _, truth, got, known = found
    taken = {(x.doc_id, x.candidate) for x in got if x.is_secret} - known
    wanted = {(i, v) for i, (v, yes) in truth.items() if yes}
    print(f"planted {len(wanted)}, found {len(wanted & taken)}, others {len(truth) - len(wanted)}, taken by mistake {len(taken - wanted)}", sorted(taken - wanted)[:12], sorted(wanted - taken)[:12])
    assert len(wanted & taken) >= 0.9 * len(wanted)
    assert len(taken - wanted) <= 0.05 * len(wanted)


def test_short_values_are_candidates(found):
    _, truth, got, _ = found
    seen = {(x.doc_id, x.candidate) for x in got}
    assert {(i, v) for i, (v, yes) in truth.items() if yes} <= seen


def test_redacted_texts_hold_no_found_secret(found):
    df, _, got, _ = found
    clean = {x.doc_id: x.text for x in secrets.redact(df).collect()}
    assert all(x.candidate not in clean[x.doc_id] for x in got if x.is_secret)


def test_frequent_words_equal_a_plain_count(spark):
    import collections
    import re

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    seen = collections.Counter()
    for x in docs.select("text").collect():
        seen.update({w for w in re.split(r"[^\w+/=-]+|(?<=\w)_(?=$)", (x.text or "").lower()) if re.fullmatch(r"[^\W\d_]{4,20}", w)})
    want = sorted(seen, key=lambda w: (-seen[w], w))[:50]
    assert secrets.frequent_words(docs, most=50) == want


def test_edges(spark):
    rows = [(None, "password: Xk7!pq2z", None), (None, "password: Xk7!pq2z", None), (1, None, "a"), (2, "", "a"), (3, "key =", "a"), (4, "x " * 100_000 + "token=Zk7!pq2zQ4", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"candidate": F.lit(1), "ws": F.lit("w")})
    got = sorted(((x.doc_id is None, x.doc_id, x.candidate) for x in secrets.scan(df).collect()), key=str)
    assert got == [(False, 4, "Zk7!pq2zQ4"), (True, None, "Xk7!pq2z"), (True, None, "Xk7!pq2z")]
    assert secrets.scan(df.limit(0)).count() == 0


def held_back(r):
    """Shapes of secrets and of look-alikes that the forest's findings weren't written by."""
    rand = lambda n, chars=ALNUM: "".join(r.choice(chars) for _ in range(n))
    hexa, b64 = "0123456789abcdef", ALNUM + "+/"
    strong = rand(1, ALNUM[:26]) + rand(r.randrange(9, 13), ALNUM + "!#%+-") + rand(1, "0123456789") + rand(1, "!#%")
    w = lambda: r.choice("thanon inglyed sourciere kommentar verbindung ouvrage".split())
    return [
        (f"<password>{strong}</password>", strong, True),
        (f"curl -u deploy:{strong} host", strong, True),
        (f"the password is {strong} today", strong, True),
        (f"<db.secret>{strong}</db.secret>", strong, True),
        (f"export SERVICE_TOKEN={rand(32)}", None, True),
        (f'"privateKey": "{rand(44, b64)}"', None, True),
        (f"set passwd := {strong}", strong, True),
        (f"smtp://mailer:{strong}@mx", strong, True),
        (f"data:image/jpeg;base64,{rand(r.randrange(60, 200), b64)}==", None, False),
        (f"sha256-{rand(43, b64)}=", None, False),
        (f'integrity="sha512-{rand(86, b64)}=="', None, False),
        (f"checksum {rand(64, hexa)}", None, False),
        (f"revision {rand(40, hexa)} of it", None, False),
        (f"id {rand(8, hexa)}-{rand(4, hexa)}-{rand(4, hexa)}-{rand(4, hexa)}-{rand(12, hexa)}", None, False),
        (f"the secret is {w()} here", None, False),
        (f"<password>{w()}</password>", None, False),
        (f"invoice {rand(14, '0123456789')}", None, False),
        (f"class {w().title()}{w().title()}Handler2", None, False),
        (f"https://{w()}.org/{w()}/{w()}-2024-01", None, False),
        ("password = ${PASSWORD}", None, False),
    ]


def test_shapes_of_a_generator_held_back(spark):
    r = random.Random(77)
    base = [x["text"] or "" for x in table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()]
    rows, secret, harmless, i = [], set(), set(), 0
    for _ in range(15):
        for line, value, yes in held_back(r):
            ws = base[i % len(base)].split(" ")
            at = r.randrange(len(ws) + 1)
            rows.append((i, " ".join([*ws[:at], line, *ws[at:]]), "src0"))
            (secret if yes else harmless).add(i)
            if yes:
                secret.add((i, value or line.split("=")[-1].strip('"').split('"')[-1]))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = spark.createDataFrame([(k, t, "src0") for k, t in enumerate(base)], df.schema)
    known = {x.candidate for x in secrets.scan(plain).where("is_secret").collect()}
    taken = {(x.doc_id, x.candidate) for x in secrets.scan(df).where("is_secret").collect() if x.candidate not in known}
    wanted = {x for x in secret if isinstance(x, tuple)}
    wrong = {x for x in taken if x[0] in harmless}
    print(f"secrets {len(wanted)}, found {len(wanted & taken)}, look-alikes {len(harmless)}, taken {len(wrong)}", sorted(wrong)[:8], sorted(wanted - taken)[:8])
    assert len(wanted & taken) >= 0.9 * len(wanted)
    assert len({x[0] for x in wrong}) <= 0.05 * len(harmless)


def test_features_equal_plain_ones(spark):
    import re

    r = random.Random(8)
    words = ["thanon", "ouvrage", "winter"]
    rows = [(line.split()[-1], line.split()[-1], " ".join(line.split()[:-1]), r.choice(["test/a", "src/app", None])) for _ in range(4) for line, *_ in [*planted(r), *held_back(r)]]
    rows += [("Winter42thanon", "Winter42thanon", None, None), ("aaaaaaaa", "aaaaaaaa", "key =", "docs"), ("AbC+/9xQabC+/9xQ", "AbC+/9xQabC+/9xQ", "data:image/png;base64,", "a")]
    got = secrets._features(spark.createDataFrame(rows, "candidate string, word string, before string, path string"), words).collect()
    assert len(got) == len(rows)
    for x in got:
        c, before, n = x.candidate, (x.before or "").lower(), len(x.candidate)
        kind = ["d" if ch.isdigit() else "u" if ch.isupper() else "l" if ch.islower() else "s" for ch in c]
        pairs = list(zip(kind, kind[1:]))
        low = c.lower()
        vowel = ["v" if ch in "aeiou" else "c" if ch in "bcdfghjklmnpqrstvwxyz" else "" for ch in low]
        changes = sum(a != b and a != "s" for a, b in pairs)
        mixed = sum((a in "ul") + (b in "ul") == 1 and "d" in (a, b) for a, b in pairs)
        swaps = sum({a, b} == {"v", "c"} for a, b in zip(vowel, vowel[1:]))
        plain = {
            "length": n, "digits": kind.count("d") / n, "capitals": kind.count("u") / n, "smalls": kind.count("l") / n, "signs": kind.count("s") / n, "changes": changes / n, "letter_digit": mixed / n, "distinct": len(set(c)) / n, "vowel_pairs": swaps / n,
            "hex_only": float(all(ch in "0123456789abcdef" for ch in c) or all(ch in "0123456789ABCDEF" for ch in c)), "corpus_words": sum(len(w) for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", c) if w.lower() in words) / n,
            "dictionary": (n - len(re.sub(secrets.DICTIONARY, "", low))) / n, "near_secret": float(bool(re.search(secrets.NEAR_SECRET, before))), "near_harmless": float(bool(re.search(secrets.NEAR_HARMLESS, before))), "harmless_path": float(bool(re.search(secrets.HARMLESS_PATH, x.path or ""))),
            "encoded": float(before.rstrip().endswith("base64,") or bool(re.match(r"sha-?\d{1,3}-", low))),
        }
        assert {k: round(x[k], 9) for k in plain} == {k: round(float(v), 9) for k, v in plain.items()}, (c, before)
