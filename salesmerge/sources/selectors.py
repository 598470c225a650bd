"""CSS selectors over a parsed page: compiled once, matched from the right."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

Test = Callable[["Node"], bool]
_NAME = re.compile(r"[\w-]+")
_ATTRIBUTE = re.compile(r"""\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s"'\]]+))\s*([iI])?\s*)?\]""")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.IGNORECASE)


class Node:
    """An element of a page, with its place among its siblings and among those of its tag."""

    __slots__ = ("tag", "attrs", "parent", "children", "elements", "place", "type_place", "types")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []
        self.elements: list[Node] = []
        self.types: dict[str, int] = {}
        self.place = self.type_place = 0
        if parent is not None:
            parent.children.append(self)
            parent.elements.append(self)
            self.place = len(parent.elements)
            self.type_place = parent.types[tag] = parent.types.get(tag, 0) + 1

    def from_end(self) -> int:
        return len(self.parent.elements) - self.place + 1

    def type_from_end(self) -> int:
        return self.parent.types[self.tag] - self.type_place + 1


class Step(NamedTuple):
    """How an element stands to the one matched before it, and what it must be itself."""

    combinator: str
    tests: list[Test]


def _attribute(name: str, sign: str | None, value: str, fold: bool) -> Test:
    def read(node: Node) -> str | None:
        held = node.attrs.get(name)
        held = "" if held is None and name in node.attrs else held
        return held.lower() if fold and held is not None else held

    value = value.lower() if fold else value
    checks: dict[str | None, Callable[[str], bool]] = {
        None: lambda held: True,
        "=": lambda held: held == value,
        "~=": lambda held: bool(value) and value in held.split(),
        "|=": lambda held: held == value or held.startswith(value + "-"),
        "^=": lambda held: bool(value) and held.startswith(value),
        "$=": lambda held: bool(value) and held.endswith(value),
        "*=": lambda held: bool(value) and value in held,
    }
    check = checks[sign]
    return lambda node: (held := read(node)) is not None and check(held)


def _nth(text: str) -> Callable[[int], bool]:
    """`odd`, `even`, `3`, `2n+1`, `-n + 3` as a condition on a place."""
    m = _NTH.match(text)
    if not m:
        raise ValueError(f"place not supported: {text!r}")
    if m[1]:
        step, shift = 2, int(m[1].lower() == "odd")
    elif m[5]:
        step, shift = 0, int(m[5])
    else:
        step = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
        shift = int((m[3] or "+") + (m[4] or "0"))
    if not step:
        return lambda place: place == shift
    return lambda place: (place - shift) % step == 0 and (place - shift) // step >= 0


_PLACES: dict[str, Callable[[Node], int]] = {
    "nth-child": lambda node: node.place,
    "nth-last-child": Node.from_end,
    "nth-of-type": lambda node: node.type_place,
    "nth-last-of-type": Node.type_from_end,
}
_SIMPLE: dict[str, Test] = {
    "first-child": lambda node: node.place == 1,
    "last-child": lambda node: node.from_end() == 1,
    "only-child": lambda node: len(node.parent.elements) == 1,
    "first-of-type": lambda node: node.type_place == 1,
    "last-of-type": lambda node: node.type_from_end() == 1,
    "only-of-type": lambda node: node.parent.types[node.tag] == 1,
    "empty": lambda node: not any(not isinstance(c, str) or c for c in node.children),
    "root": lambda node: node.parent is not None and not node.parent.tag,
}


class Selector:
    """A list of selectors. One object serves one page at a time: it remembers siblings."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0
        self.ways = self._list("")
        self._first: dict[tuple[int, int, int], int] = {}

    def _fail(self) -> ValueError:
        return ValueError(f"selector not supported: {self.text!r}")

    def _list(self, end: str) -> list[list[Step]]:
        ways = [self._chain()]
        while self.text[self.at : self.at + 1] == ",":
            self.at += 1
            ways.append(self._chain())
        if self.text[self.at : self.at + 1] != end:
            raise self._fail()
        self.at += len(end)
        return ways

    def _blanks(self) -> None:
        while self.text[self.at : self.at + 1].isspace():
            self.at += 1

    def _chain(self) -> list[Step]:
        self._blanks()
        steps, combinator = [], " "
        while True:
            steps.append(Step(combinator, self._compound()))
            m = _COMBINATOR.match(self.text, self.at)
            if not m or self.text[m.end() : m.end() + 1] in ("", ",", ")"):
                self._blanks()
                return steps
            combinator, self.at = m[1] or " ", m.end()

    def _word(self) -> str:
        m = _NAME.match(self.text, self.at)
        if not m:
            raise self._fail()
        self.at = m.end()
        return m[0]

    def _compound(self) -> list[Test]:
        tests, begin = [], self.at
        while self.at < len(self.text):
            char = self.text[self.at]
            if char == "*" and self.at == begin:
                self.at += 1
                tests.append(lambda node: True)
            elif char in ".#":
                self.at += 1
                tests.append(_attribute("class" if char == "." else "id", "~=" if char == "." else "=", self._word(), False))
            elif char == "[":
                m = _ATTRIBUTE.match(self.text, self.at)
                if not m:
                    raise self._fail()
                self.at = m.end()
                value = next((v for v in m.groups()[2:5] if v is not None), "")
                tests.append(_attribute(m[1].lower(), m[2], value, bool(m[6])))
            elif char == ":":
                self.at += 1
                tests.append(self._pseudo(self._word().lower()))
            elif self.at == begin and _NAME.match(self.text, self.at):
                tests.append((lambda tag: lambda node: node.tag == tag)(self._word().lower()))
            else:
                break
        if not tests:
            raise self._fail()
        return tests

    def _pseudo(self, name: str) -> Test:
        if name in _SIMPLE:
            return _SIMPLE[name]
        if self.text[self.at : self.at + 1] != "(":
            raise self._fail()
        self.at += 1
        if name in _PLACES:
            end = self.text.find(")", self.at)
            if end < 0:
                raise self._fail()
            place, fits = _PLACES[name], _nth(self.text[self.at : end])
            self.at = end + 1
            return lambda node: fits(place(node))
        if name not in ("not", "is", "where"):
            raise self._fail()
        ways = self._list(")")
        inner = lambda node: any(self._matches(node, steps, len(steps) - 1) for steps in ways)
        return (lambda node: not inner(node)) if name == "not" else inner

    def page_ends(self) -> None:
        """Forget the siblings of a page."""
        self._first.clear()

    def matches(self, node: Node) -> bool:
        return any(self._matches(node, steps, len(steps) - 1) for steps in self.ways)

    def _matches(self, node: Node, steps: list[Step], k: int) -> bool:
        if not all(test(node) for test in steps[k].tests):
            return False
        if k == 0:
            return True
        combinator, above = steps[k].combinator, node.parent
        if combinator == "+":
            return node.place > 1 and self._matches(above.elements[node.place - 2], steps, k - 1)
        if combinator == "~":
            return self._first_place(above, steps, k - 1) < node.place
        while above is not None and above.tag:
            if self._matches(above, steps, k - 1):
                return True
            if combinator == ">":
                return False
            above = above.parent
        return False

    def _first_place(self, parent: Node, steps: list[Step], k: int) -> int:
        """Place of the first child that matches the first steps; looked for once per parent."""
        key = (id(parent), id(steps), k)
        if key not in self._first:
            found = (e.place for e in parent.elements if self._matches(e, steps, k))
            self._first[key] = next(found, len(parent.elements) + 1)
        return self._first[key]
