"""Operator 9, secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.llm.common import free, materialise, own

#: Shortest candidate, where nothing but its form speaks for it, and where a secret's name is set to it.
LEAST, LEAST_NAMED = 16, 6
_RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: A run is a candidate if it has a digit, a capital after a small letter, or capitals only.
_ODD = r"[0-9]|[a-z][A-Z]|^[A-Z]+$"

# Public key formats, words near secrets, words near harmless digests, and common parts of names and prose.
FORMATS = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"[rs]k_live_[0-9A-Za-z]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+)*",
}
NEAR_SECRET = "key|token|secret|passw|pwd|passphrase|auth|credential|bearer|apikey|private"
NEAR_HARMLESS = "sha|md5|commit|checksum|digest|hash|uuid|guid|revision|etag|phone|card|isbn|version|build|invoice|order|http|www"
DICTIONARY = "the|and|ing|tion|ment|data|file|test|example|sample|image|page|index|config|user|name|value|string|number|class|module|python|build|version|debug|error|public|static|return|import|default|message|request|response|session|service|server|client|system|local|update|create|delete|sch|ung|eau|eux|que|cion"
HARMLESS_PATH = "test|example|sample|mock|fixture|doc|vendor|lock"
STAND_INS = r"^[<\[{$%*]|^(?:(.)\1+)$|(?i)^your|changeme|placeholder|redacted|example|\(|\.env"

_OPEN, _END = r"[\"'`(\[]{0,2}", r"[\"'`]?[,;.)\]}]*$"
#: What a secret's name is set to: 'password = "..."', 'api_key: ...'.  The last word of the text it is sought in holds the value.
_NAMED = rf"(?i)(?:{NEAR_SECRET})[A-Za-z0-9_.-]{{0,20}}[\"'`\])]{{0,2}}\s*[:=]+>?\s*{_OPEN}([^\s\"'`]{{{LEAST_NAMED},}}?){_END}"
#: The password of an address: 'scheme://name:...@host'.
_USERINFO = rf"://[^/\s:@]+:([^\s/@]{{{LEAST_NAMED},}})@"
#: What stands in a secret's element, after a command's user option, or after a sentence's 'password is'.
_TAGGED = rf"(?i)<[a-z0-9_.:-]{{0,20}}(?:{NEAR_SECRET})[a-z0-9_.-]{{0,20}}>([^\s<>]{{{LEAST_NAMED},}})</"
_USER = r"(?:^|\s)(?:-u|--user)[\s=]+[\"']?[^\s:@/\"']+:"
_USER_VALUE = rf"{_USER}([^\s\"']{{{LEAST_NAMED},}})"
_SAID = r"(?i)(?:password|passphrase|passcode|passwd|pwd|secret|token|api.?key|access.?key)\s+(?:is|was)\s+"
_SAID_VALUE = rf"{_SAID}{_OPEN}([^\s\"'`]{{{LEAST_NAMED},}}?){_END}"
#: What an encoded picture or an integrity digest begins with: public, though it looks random.
_ENCODED, _INTEGRITY = r"(?i)base64,\s*$|(?i)sha-?[0-9]{1,3}[-:]\s*$", r"(?i)^sha-?[0-9]{1,3}-"
#: A text without this has no named value.
_SET = rf"(?i)(?:{NEAR_SECRET})[A-Za-z0-9_.-]{{0,20}}[\"'`\])]{{0,2}}[\x20\x09-\x0D]*[:=]|://[^/\s:@]+:[^\s/@]+@"

#: Nor is there one without this in a text that has no sign of assignment.
_SET_BESIDE = rf"{_TAGGED}|(?:^|\s)(?:-u|--user)\s|{_SAID}"

FEATURES = ["length", "digits", "capitals", "smalls", "signs", "changes", "letter_digit", "distinct", "vowel_pairs", "hex_only", "dictionary", "corpus_words", "in_path", "harmless_path", "assigned", "near_secret", "near_harmless", "userinfo", "stand_in", "known_format", "encoded"]


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = 500) -> list[str]:
    """The ``most`` words of 4 to 20 letters that stand in most documents, ties by the word; counted over all whole texts."""
    edge = r"[\p{L}\p{N}+/_=-]"
    plain = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(rf"(?<!{edge})(\p{{L}}{{4,20}})(?!{edge})"), 1)
    counts = docs.select(F.explode(F.array_distinct(plain)).alias("w")).groupBy("w").count()
    return [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(most).collect()]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every value that may be a secret: doc_id, at (the word's place), candidate, word, before, after, path.

    Candidates are runs of at least LEAST key characters that aren't plain prose,
    and values of any signs of at least LEAST_NAMED characters that a secret's name
    is set to (in the same word or the two before it), that stand as the password of an address, in an
    element of a secret's name or after a command's user option, or of which a sentence says that they are the password.
    Words are parted by white space; ``before`` holds what precedes the candidate in
    its word and the two words before it.
    """
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    text = F.col(text_col).cast("string")
    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))  # most texts have none and need no search for names
    ws = docs.where(text.rlike(_RUN) | (sign & text.rlike(_SET)) | text.rlike(_SET_BESIDE)).select(F.col(id_col).alias("doc_id"), path.alias("path"), F.split(text, r"[\x20\x09-\x0D]+").alias("ws"))
    long_run = lambda w: (F.length(w) >= LEAST) & w.rlike(_RUN)
    named = lambda i: (F.length(F.get("ws", i)) >= LEAST_NAMED) & (F.get("ws", i).rlike("[:=]") | F.coalesce(F.get("ws", i - 1).rlike(r"[:=]>?[\"'`(\[]{0,2}$"), F.lit(False)) | F.contains(F.get("ws", i), F.lit("</")) | F.coalesce(F.lower(F.get("ws", i - 1)).isin("is", "was", "-u", "--user"), F.lit(False)))
    hits = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: long_run(F.get("ws", i)) | named(i))
    # No filter on the hits, and an outer generator, which implies none: pushed down, it would split the text again for every word.
    found = ws.select("doc_id", "path", "ws", hits.alias("hits"))
    # Only the few words of interest leave the array, so that it isn't copied for each.
    near = F.transform("hits", lambda i: F.struct(i.alias("at"), F.get("ws", i).alias("word"), F.concat_ws(" ", F.get("ws", i - 2), F.get("ws", i - 1)).alias("prior"), F.get("ws", i + 1).alias("after")))
    rows = found.select("doc_id", "path", near.alias("near")).select("doc_id", "path", F.inline_outer("near")).where("at IS NOT NULL")
    # 'password=...' is one run: the name before the sign belongs to the context.
    runs = F.transform(F.regexp_extract_all("word", F.lit(f"({_RUN})"), 1), lambda r: F.regexp_replace(r, r"^[A-Za-z_-]{2,40}=", ""))
    runs = F.filter(runs, lambda r: (F.length(r) >= LEAST) & r.rlike(_ODD))
    # A value that reaches back over the word's start is another word's.
    around = F.concat_ws(" ", "prior", "word")
    shapes = F.array(*(F.regexp_extract(around, p, 1) for p in (_NAMED, _USER_VALUE, _SAID_VALUE)), *(F.regexp_extract("word", p, 1) for p in (_USERINFO, _TAGGED)))
    values = F.filter(shapes, lambda v: (v != "") & F.contains(F.col("word"), v))
    rows = rows.select("doc_id", "path", "at", "word", "prior", "after", values.alias("values"), runs.alias("runs"))
    # A run within a longer value is no candidate of its own.
    alone = F.filter("runs", lambda r: ~F.exists("values", lambda v: F.contains(v, r) & (v != r)))
    rows = rows.withColumn("candidate", F.explode(F.array_distinct(F.concat("values", alone))))
    lead = F.expr("substring(word, 1, greatest(locate(candidate, word) - 1, 0))")
    return rows.select("doc_id", "at", "candidate", "word", F.concat_ws(" ", "prior", lead).alias("before"), "after", "path")


def _features(found: DataFrame, words: list[str]) -> DataFrame:
    known = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    c, low = F.col("candidate"), F.lower("candidate")
    before, path = F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("path", F.lit("")))
    n = F.length(c).cast("double")
    count = lambda pattern, of=c: F.regexp_count(of, F.lit(pattern)).cast("double")
    flag = lambda b: F.coalesce(b, F.lit(False)).cast("double")
    covered = n - F.length(F.regexp_replace(low, DICTIONARY, ""))
    parts = F.transform(F.regexp_extract_all(c, F.lit(r"(\p{Lu}?\p{Ll}+|\p{Lu}+)"), 1), F.lower)
    in_words = F.aggregate(F.filter(parts, lambda w: F.array_contains(known, w)), F.lit(0), lambda a, w: a + F.length(w))
    values = {
        "length": n,
        "digits": count("[0-9]") / n,
        "capitals": count("[A-Z]") / n,
        "smalls": count("[a-z]") / n,
        "signs": count("[^A-Za-z0-9]") / n,
        "changes": count("[0-9](?=[^0-9])|[A-Z](?=[^A-Z])|[a-z](?=[^a-z])") / n,
        "letter_digit": count("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "vowel_pairs": count("[aeiou](?=[bcdfghjklmnpqrstvwxyz])|[bcdfghjklmnpqrstvwxyz](?=[aeiou])", low) / n,
        "hex_only": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "dictionary": covered / n,
        "corpus_words": in_words / n,
        "in_path": flag(F.col("word").rlike(r"://|^www\.|/[^/]+/|\.[a-z]{2,4}(/|$)|@")),
        "harmless_path": flag(path.rlike(HARMLESS_PATH)),
        "assigned": flag(before.rlike(r"([=:]>?|>|\s(is|was))\s*[\"'`(\[]{0,2}\s*$")),
        "near_secret": flag(before.rlike(NEAR_SECRET)),
        "near_harmless": flag(before.rlike(NEAR_HARMLESS)),
        "userinfo": flag(F.col("word").rlike(_USERINFO) | before.rlike(_USER)),
        "stand_in": flag(c.rlike(STAND_INS)),
        "known_format": flag(c.rlike("|".join(f"^(?:{p})$" for p in FORMATS.values()))),
        "encoded": flag(before.rlike(_ENCODED) | c.rlike(_INTEGRITY)),
    }
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in values.items()})


def labelled_findings(spark: SparkSession, words: list[str], each: int = 150) -> DataFrame:
    """Labelled findings by rule, for want of a reviewed table: ``each`` rows of every kind, label 1 for secrets.

    Names, prose values and the words before a candidate are made of the corpus's own
    frequent ``words``.  Columns candidate, word, before, path and label; a reviewed table of the same
    columns can take its place.
    """
    words = words or DICTIONARY.split("|")
    own_word = lambda salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.lit(salt), "i"), F.lit(len(words))) + 1).cast("int"))
    prose = lambda salt: F.concat_ws(" ", own_word(salt), own_word(salt + "2"), F.lit(""))
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("i").cast("string")), 256)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(h(salt))), "=+$", "")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.pmod(F.xxhash64("i"), F.lit(len(v))) + 1).cast("int"))
    cut = lambda c, lo, hi: c.substr(F.lit(1), (lo + F.pmod(F.xxhash64(F.lit("n"), "i"), F.lit(hi - lo + 1))).cast("int"))
    secret = pick("api_key", "token", "client_secret", "password", "auth_token", "access key", "the private key", "secret")
    sign = pick(" = ", "=", ": ", ' = "', "='")
    digits = F.regexp_replace(F.translate(h("d"), "abcdef", "123456"), "^0", "7")
    names = pick("responseMessageHandler2", "user-session-service-config1", "test_example_module_v2", "publicStaticReturnValue", "defaultRequestNumber10", "theandingtionment-2024", "index_page_image_file_01", "SystemLocalUpdateClient")
    joint = pick("_", "-", "/")
    end = pick("!", "&3", "#", "$7", "@1", "", "*", "?9")
    mixed = F.concat(b64("p").substr(1, 4), pick("!", "@", "#", "%", "&", "-", "_", ""), cut(b64("q"), 2, 9), h("r").substr(1, 1))
    spelled = F.concat(F.initcap(F.translate(own_word("s"), "aeio", "a3i0")), h("t").substr(1, 1), F.regexp_extract(digits, "^(.{2})", 1), end)
    name = F.concat(pick("api_key", "token", "password", "key", "secret", "auth", "Password", "credentials"), sign)
    blob = F.concat_ws("", *(b64(f"blob{k}") for k in range(8)))
    told = pick("the password is ", "my password was ", "passphrase is ", "the secret is ", "new token is ", "its api key is ")
    tag = pick("<password>", "<secret>", "<api-token>", "<authToken>", "<db.password>", "<pwd>")
    user = pick("-u admin:", "--user bob:", "curl -u svc:", "-u 'root:")
    kinds = [
        (1, mixed, told, F.lit("docs")),
        (1, spelled, told, F.lit("data")),
        (1, mixed, tag, F.lit("src/app")),
        (1, spelled, tag, F.lit("data")),
        (1, mixed, user, F.lit("src/app")),
        (1, spelled, user, F.lit("data")),
        (0, own_word("said"), told, F.lit("data")),
        (0, own_word("tag"), tag, F.lit("docs")),
        (0, own_word("user"), user, F.lit("docs")),
        (0, cut(blob, 24, 340), pick("data:image/png;base64,", 'src="data:image/gif;base64,', "url(data:font/woff2;base64,", "data:application/pdf;base64,"), F.lit("src/app")),
        (0, F.concat(pick("sha256-", "sha384-", "sha512-", "sha1-"), cut(blob, 27, 86), pick("=", "==", "")), pick('integrity="', "integrity: ", '"integrity": "', "", "the "), F.lit("data")),
        (1, mixed, name, F.lit("src/app")),
        (1, spelled, name, F.lit("data")),
        (1, mixed, pick("postgres://app:", "https://user:", "ftp://root:", "amqp://svc:"), F.lit("src/app")),
        (0, own_word("u"), name, F.lit("data")),
        (0, F.translate(h("v").substr(1, 9), "0123456789", "eanirstoul"), name, F.lit("data")),
        (0, pick("required", "undefined", "yourpassword", "<password>", "${TOKEN}", "changeme", "********", "process.env.KEY", "get_token()", "placeholder", "xxxxxxxx", "{{secret}}"), name, F.lit("src/app")),
        (0, F.date_format(F.date_add(F.lit("2015-01-01"), F.col("i").cast("int") * 23), "yyyy-MM-dd"), name, F.lit("log")),
        (0, F.concat(own_word("w"), joint, own_word("x"), joint, pick("2", "v3", "10", "2024")), F.concat(prose("y"), pick("", "", "key = ", "token: ")), F.lit("src/app")),
        (0, F.concat(own_word("w"), F.initcap(own_word("x")), F.initcap(own_word("z")), pick("", "2", "10")), prose("y"), F.lit("data")),
        (1, cut(h("a"), 18, 64), F.concat(secret, sign), F.lit("src/app")),
        (1, cut(b64("b"), 20, 43), F.concat(secret, sign), F.lit("src/app")),
        (1, F.concat(F.lit("AKIA"), F.upper(F.translate(h("c").substr(1, 16), "0189", "ghjk"))), pick("see the ", "id ", "", "export X="), F.lit("src/app")),
        (1, F.concat(F.lit("ghp_"), b64("e").substr(1, 36)), pick("git clone ", "use ", "", "token "), F.lit("src/app")),
        (1, F.concat(F.upper(h("x").substr(1, 10)), h("y").substr(1, 14)), F.concat(secret, sign), F.lit("data")),
        (0, cut(h("f"), 32, 64), pick("commit ", "sha256: ", "md5 = ", "checksum ", "etag: ", "digest="), F.lit("docs")),
        (0, F.concat_ws("-", h("g").substr(1, 8), h("g").substr(9, 4), h("g").substr(13, 4), h("g").substr(17, 4), h("g").substr(21, 12)), pick("uuid ", "id: ", "request ", "guid = "), F.lit("log")),
        (0, digits.substr(1, 16), pick("card ", "order ", "number ", "the ", "of "), F.lit("data")),
        (0, names, pick("class ", "import ", "see ", "the ", "token ", "key = "), F.lit("src/app")),
        (0, F.concat(names, F.lit("/"), h("k").substr(1, 8)), pick("https://host/", "www.host/", "open /usr/lib/", "/var/"), F.lit("docs")),
        (0, F.concat(F.upper(F.translate(h("m").substr(1, 20), "0123456789", "thenadsior"))), pick("the ", "of ", "and ", ""), F.lit("data")),
        (0, F.concat(F.lit("example"), h("o").substr(1, 12)), F.concat(secret, sign), F.lit("test/fixture")),
    ]
    base = spark.range(0, each, 1, 1).withColumnRenamed("id", "i")
    out = None
    for label, c, before, path in kinds:
        part = base.select(c.alias("candidate"), before.alias("before"), path.alias("path"), F.lit(label).alias("label"))
        out = part if out is None else out.unionByName(part)
    last = F.regexp_extract("before", r"(\S*)$", 1)
    host = F.when(F.col("before").contains("://") & ~F.col("candidate").contains("/") & (F.col("label") == 1), F.lit("@host")).otherwise(F.lit(""))
    return out.withColumn("word", F.concat(last, "candidate", host)).coalesce(1)


def train(findings: DataFrame, words: list[str], trees: int = 24, depth: int = 8) -> RandomForestClassificationModel:
    """A random forest on labelled findings (candidate, word, before, path, label)."""
    known = materialise(_features(findings, words).select(*FEATURES, F.col("label").cast("double").alias("label")), "secret-findings")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(known).select("v", "label")
    return RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=11).fit(rows)


def _rule() -> Column:
    out = F.lit("generic")
    for name, pattern in FORMATS.items():
        out = F.when(F.col("candidate").rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """All candidates of whole texts with the forest's verdict: doc_id, at, candidate, rule, length, score, is_secret.

    Null and empty texts and texts without a candidate give no row; a candidate
    that occurs several times in a text gives a row for each word it stands in.
    A null path counts as no path.  Repeated and null ids keep their own rows; an empty table gives an
    empty one.  The corpus's frequent words are counted first; the scan itself shuffles
    nothing: each task scans its own texts.
    """
    words = frequent_words(docs, text_col)
    model = train(labelled_findings(docs.sparkSession, words) if findings is None else findings, words)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(_features(candidates(docs, id_col, text_col, path_col), words))
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "at", "candidate", _rule().alias("rule"), F.col("length").cast("long").alias("length"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", **options) -> DataFrame:
    """The documents with every found secret replaced by ``mark``; the input's columns.

    Rows are numbered first and stored, so that rows of a null or repeated id get
    their own secrets taken out.  Longer secrets go before shorter ones that
    they may hold.  Null and empty texts stay as they are; an empty table gives
    an empty one.
    """
    row, found_row, hits = free(docs, "_row", "_found", "_secrets")
    names = docs.columns
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "secret-rows")
    found = scan(rows, id_col=row, text_col=text_col, **options).where("is_secret").groupBy(F.col("doc_id").alias(found_row)).agg(F.collect_set(F.struct((-F.length("candidate")).alias("n"), "candidate")).alias(hits))
    joined = rows.join(materialise(found, "secrets"), F.col(row) == F.col(found_row), "left")
    ordered = F.transform(F.array_sort(hits), lambda x: x["candidate"])
    text = F.aggregate(F.coalesce(ordered, F.array().cast("array<string>")), F.col(text_col).cast("string"), lambda t, s: F.replace(t, s, F.lit(mark)))
    return joined.select(*(text.alias(c) if c == text_col else own(docs, c) for c in names))
