"""An adaptive radix tree over byte keys, built by one task for its own range of keys."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """A node with a compressed prefix, children by next byte, and the record of the key that ends here, if one does.

    Children lie in one of four layouts, and a node moves to the next when one is full: up to 4
    and up to 16 children as sorted bytes beside a list, up to 48 by an index of 256
    slots into a list, beyond that as a list of 256.
    """

    __slots__ = ("prefix", "end", "size", "keys", "kids")

    def __init__(self, prefix: bytes, end: int = -1):
        self.prefix, self.end, self.size = prefix, end, 4
        self.keys: bytearray | None = bytearray()
        self.kids: list[Node | None] = []

    def find(self, byte: int) -> Node | None:
        if self.size <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.size == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Set the child of a byte, in place of an old one or as a new one."""
        if self.size == 256:
            self.kids[byte] = kid
            return
        if self.size == 48:
            at = self.keys[byte]
            if at:
                self.kids[at - 1] = kid
            elif len(self.kids) < 48:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
            else:
                self.kids = [self.kids[at - 1] if at else None for at in self.keys]
                self.keys, self.size = None, 256
                self.kids[byte] = kid
            return
        at = self.keys.find(byte)
        if at >= 0:
            self.kids[at] = kid
            return
        if len(self.kids) == self.size:
            self.size = 16 if self.size == 4 else 48
            if self.size == 48:
                index = bytearray(256)
                for i, k in enumerate(self.keys):
                    index[k] = i + 1
                self.keys = index
                self.put(byte, kid)
                return
        at = sum(k < byte for k in self.keys)
        self.keys.insert(at, byte)
        self.kids.insert(at, kid)

    def children(self) -> Iterator[Node]:
        """In the order of their bytes."""
        if self.size == 48:
            return (self.kids[at - 1] for at in self.keys if at)
        return (k for k in self.kids if k is not None)


def insert(root: Node, key: bytes, record: int) -> Node:
    """Add a key that isn't there yet; returns the root, which a split may have replaced."""
    above, byte, node, at = None, 0, root, 0
    while True:
        p = node.prefix
        if key.startswith(p, at):
            at += len(p)
            if at == len(key):
                node.end = record
                return root
            kid = node.find(key[at])
            if kid is None:
                node.put(key[at], Node(key[at + 1 :], record))
                return root
            above, byte, node, at = node, key[at], kid, at + 1
            continue
        rest = key[at : at + len(p)]
        same = next((i for i, (x, y) in enumerate(zip(p, rest)) if x != y), len(rest))
        top = Node(p[:same])
        node.prefix = p[same + 1 :]
        top.put(p[same], node)
        if at + same == len(key):
            top.end = record
        else:
            top.put(key[at + same], Node(key[at + same + 1 :], record))
        if above is None:
            return top
        above.put(byte, top)
        return root


def walk(root: Node) -> list[tuple[Node, int, int, int]]:
    """All nodes, each before its children: node, place of its parent in the list (-1: none), depth of the parent's end and of its own."""
    out = [(root, -1, -1, len(root.prefix))]
    at = 0
    stack = [0]
    while stack:
        at = stack.pop()
        node, _, _, end = out[at]
        for kid in node.children():
            out.append((kid, at, end, end + 1 + len(kid.prefix)))
            stack.append(len(out) - 1)
    return out
