"""The tree that a run builds: nodes with ordered attributes, and a cursor."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from ..functions.text import normalize_name, percent_decode

#: Name and creation attributes of one step of a path.
Step = tuple[str, tuple[tuple[str, str], ...]]


def _split_steps(path: str) -> list[str]:
    """At slashes that aren't within double quotes."""
    if '"' not in path:
        return path.split("/")
    out, quoted, start = [], False, 0
    for i, c in enumerate(path):
        if c == '"':
            quoted = not quoted
        elif c == "/" and not quoted:
            out.append(path[start:i])
            start = i + 1
    return [*out, path[start:]]


def parse_path(path: str, preserve_case: bool = False) -> tuple[Step, ...]:
    """``a/b?k="v"&l="w"`` as steps; of repeated keys the first counts."""
    steps = []
    for part in _split_steps(path):
        if not part:
            continue
        tag, has_query, query = part.partition("?")
        attrs: dict[str, str] = {}
        for pair in query.split("&") if has_query else ():
            key, equals, value = pair.partition("=")
            if equals:
                value = value.strip()
                if len(value) >= 2 and value[0] == value[-1] == '"':
                    value = value[1:-1]
                attrs.setdefault(percent_decode(normalize_name(key.strip(), preserve_case)), percent_decode(value))
        steps.append((normalize_name(percent_decode(tag).strip(), preserve_case), tuple(attrs.items())))
    return tuple(steps)


def identity(attrs: tuple[tuple[str, str], ...]) -> object:
    """What tells apart children of one name: their creation attributes, in any order."""
    return attrs[0] if len(attrs) == 1 else frozenset(attrs)


class Node:
    __slots__ = ("name", "attrs", "added", "text", "children", "newest")

    def __init__(self, name: str, attrs: tuple[tuple[str, str], ...] = ()):
        self.name = name
        #: As created, which is a part of the node's identity, and as added later.
        self.attrs = attrs
        self.added: list[tuple[str, str]] | None = None
        self.text: str | None = None
        #: A list from the first child on.
        self.children: list[Node] | tuple[()] = ()
        #: The newest child of each name; under the name in a tuple, those with attributes by :func:`identity`.
        self.newest: dict | None = None

    def append(self, name: str, attrs: tuple[tuple[str, str], ...]) -> Node:
        child = Node(name, attrs)
        if self.newest is None:
            self.newest, self.children = {}, []
        self.children.append(child)
        if attrs:
            self.newest.setdefault((name,), {})[identity(attrs)] = child
        else:
            self.newest[name] = child
        return child

    def find(self, name: str, attrs: tuple[tuple[str, str], ...]) -> Node | None:
        """The newest child with this name and these creation attributes, in any order."""
        if not self.newest:
            return None
        return self.newest.get((name,), {}).get(identity(attrs)) if attrs else self.newest.get(name)

    def all_attrs(self) -> list[tuple[str, str]]:
        """A repeated key stays where it was first, with its last value."""
        if not self.added:
            return list(self.attrs)
        return list((dict(self.attrs) | dict(self.added)).items())

    def groups(self) -> list[list[Node]]:
        """The children by name, names in the order of their first children."""
        if len(self.children) < 2:
            return [self.children] if self.children else []
        by_name: dict[str, list[Node]] = {}
        for c in self.children:
            group = by_name.get(c.name)
            if group is None:
                by_name[c.name] = [c]
            else:
                group.append(c)
        return list(by_name.values())

    def is_empty(self) -> bool:
        return not (self.attrs or self.added or self.text or self.children)


class Tree:
    def __init__(self, preserve_case: bool = False, paths: dict[str, tuple[Step, ...]] | None = None):
        self.root = Node("")
        self.stack = [self.root]
        self.preserve_case = preserve_case
        self._paths = {} if paths is None else paths

    def steps(self, path: str) -> tuple[Step, ...]:
        got = self._paths.get(path)
        if got is None:
            if len(self._paths) > 20_000:
                self._paths.clear()
            got = self._paths[path] = parse_path(path, self.preserve_case)
        return got

    def walk(self, steps: tuple[Step, ...], new_leaf: bool) -> Node:
        """From the cursor down, with missing nodes made; ``.`` stays."""
        at = self.stack[-1]
        last = len(steps) - 1
        for i, (name, attrs) in enumerate(steps):
            if name == ".":
                continue
            at = (None if new_leaf and i == last else at.find(name, attrs)) or at.append(name, attrs)
        return at

    def _target(self, path: str, new_leaf: bool) -> Node | None:
        """The node that create, add and replace write to; none for an empty path."""
        if path == ".":
            return self.stack[-1]
        steps = self.steps(path)
        if not steps:
            return None
        if steps[0][0] == "." and path[0] != "." and "/" not in path:  # a name that only reads as a dot once decoded
            at = self.stack[-1]
            return (None if new_leaf else at.find(*steps[0])) or at.append(*steps[0])
        return self.walk(steps, new_leaf)

    def create(self, path: str, text: str | None) -> None:
        node = self._target(path, True)
        if node is not None:
            node.text = text

    def add(self, path: str, text: str | None) -> None:
        node = self._target(path, False)
        if node is not None and text is not None:
            node.text = text if node.text is None else node.text + text

    def add_at(self, steps: tuple[Step, ...], text: str | None) -> None:
        if steps:
            node = self.walk(steps, False)
            if text is not None:
                node.text = text if node.text is None else node.text + text

    def replace(self, path: str, text: str | None) -> None:
        if path == ".":
            self.stack[-1].text = text
        elif steps := self.steps(path):
            self.walk(steps, False).text = text

    def add_attribute(self, path: str, key: str, value: str) -> None:
        if path == ".":
            node = self.stack[-1]
        else:
            steps = self.steps(path)
            if not steps:
                return
            node = self.walk(steps, False)
        if node.added is None:
            node.added = []
        node.added.append((key, value))

    def open(self, path: str) -> None:
        self.stack.append(self.walk(self.steps(path), True))

    def enter(self, path: str) -> None:
        self.stack.append(self.walk(self.steps(path), False))

    def leave(self) -> None:
        if len(self.stack) > 1:
            self.stack.pop()

    def breadth_first(self, paths: bool = True) -> Iterator[tuple[int, int | None, int, int, Node, str]]:
        """(id, parent's id, depth, place among its siblings, node, path), with
        children of one name together; paths are empty unless wanted."""
        yield 0, None, 0, 0, self.root, ""
        # Only nodes with children are kept for the next level.
        level = [(0, self.root, "")] if self.root.children else []
        next_id, depth = 1, 1
        while level:
            below = []
            for parent, node, path in level:
                for i, c in enumerate(chain.from_iterable(node.groups())):
                    at = f"{path}/{c.name}" if paths else ""
                    yield next_id, parent, depth, i, c, at
                    if c.children:
                        below.append((next_id, c, at))
                    next_id += 1
            level, depth = below, depth + 1
