"""Adaptive radix tree over byte strings: path compression, and node layouts that grow with their children."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

NONE = 0xFF  # no child, in the index of a layout of 48


class Sorted:
    """Up to 4 or 16 children: their bytes in order beside them."""

    __slots__ = ("size", "bytes", "children")

    def __init__(self, size: int, pairs=()):
        self.size = size
        self.bytes = bytearray(byte for byte, _ in pairs)
        self.children = [child for _, child in pairs]

    def find(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return None if at < 0 else self.children[at]

    def put(self, byte: int, child: Node) -> Layout:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.children[at] = child
        elif len(self.bytes) == self.size:
            larger = Sorted(16, list(self.pairs())) if self.size == 4 else Indexed(self.pairs())
            return larger.put(byte, child)
        else:
            self.bytes.insert(at, byte)
            self.children.insert(at, child)
        return self

    def pairs(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.children)


class Indexed:
    """Up to 48 children: a place for each of 256 bytes says where the child is."""

    __slots__ = ("places", "children")
    size = 48

    def __init__(self, pairs=()):
        self.places = bytearray([NONE]) * 256
        self.children = []
        for byte, child in pairs:
            self.put(byte, child)

    def find(self, byte: int) -> Node | None:
        at = self.places[byte]
        return None if at == NONE else self.children[at]

    def put(self, byte: int, child: Node) -> Layout:
        at = self.places[byte]
        if at != NONE:
            self.children[at] = child
        elif len(self.children) == self.size:
            return Full(self.pairs()).put(byte, child)
        else:
            self.places[byte] = len(self.children)
            self.children.append(child)
        return self

    def pairs(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.children[at]) for byte, at in enumerate(self.places) if at != NONE)


class Full:
    """A child or nothing for each of 256 bytes."""

    __slots__ = ("children",)
    size = 256

    def __init__(self, pairs=()):
        self.children = [None] * 256
        for byte, child in pairs:
            self.children[byte] = child

    def find(self, byte: int) -> Node | None:
        return self.children[byte]

    def put(self, byte: int, child: Node) -> Layout:
        self.children[byte] = child
        return self

    def pairs(self) -> Iterator[tuple[int, Node]]:
        return ((byte, child) for byte, child in enumerate(self.children) if child is not None)


Layout = Sorted | Indexed | Full


class Node:
    """``prefix`` is the compressed path from the branching byte on; ``value`` belongs to the key that ends here."""

    __slots__ = ("prefix", "layout", "value")

    def __init__(self, prefix: bytes, value: Any = None):
        self.prefix = prefix
        self.layout: Layout | None = None
        self.value = value

    def find(self, byte: int) -> Node | None:
        return self.layout.find(byte) if self.layout else None

    def put(self, byte: int, child: Node) -> None:
        self.layout = (self.layout or Sorted(4)).put(byte, child)

    def children(self) -> list[Node]:
        """In the order of their bytes."""
        return [child for _, child in self.layout.pairs()] if self.layout else []


def common_length(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common from their starts."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    apart = int.from_bytes(a) ^ int.from_bytes(b)
    return n - (apart.bit_length() + 7) // 8


class RadixTree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, value: Any) -> None:
        """Values are not None; a key's later value replaces the earlier one."""
        if self.root is None:
            self.root = Node(key, value)
            return
        above, node, at = None, self.root, 0
        while True:
            shared = common_length(node.prefix, key[at : at + len(node.prefix)])
            if shared < len(node.prefix):
                split = Node(node.prefix[:shared])
                split.put(node.prefix[shared], node)
                node.prefix = node.prefix[shared + 1 :]
                if above is None:
                    self.root = split
                else:
                    above.put(key[at - 1], split)
                node = split
            at += shared
            if at == len(key):
                node.value = value
                return
            child = node.find(key[at])
            if child is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            above, node, at = node, child, at + 1

    def get(self, key: bytes) -> Any:
        node, at = self.root, 0
        while node is not None:
            if key[at : at + len(node.prefix)] != node.prefix:
                return None
            at += len(node.prefix)
            if at == len(key):
                return node.value
            node, at = node.find(key[at]), at + 1
        return None

    def bottom_up(self) -> Iterator[tuple[Node, int, int, list[Node]]]:
        """Every node after its children: (node, bytes above its edge, bytes down to its end, children)."""
        todo = [(self.root, 0, False, [])] if self.root else []
        while todo:
            node, start, ready, children = todo.pop()
            # The edge of every node but the root begins with the byte it branches by.
            end = start + len(node.prefix) + (node is not self.root)
            if ready:
                yield node, start, end, children
                continue
            children = node.children()
            todo.append((node, start, True, children))
            todo.extend((child, end, False, []) for child in reversed(children))
