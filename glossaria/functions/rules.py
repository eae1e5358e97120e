"""Morphological rewrite rules: conditions, rule sets and the closure of rewrites over one word.

A rule rewrites an inflected form towards a dictionary form. It applies where its pattern is met and its inner
conditions agree with what is known of the form so far: nothing known agrees with everything, and a rule without inner
conditions only applies while nothing is known. Flags of conditions are bits; a group's flags are those of its members.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

MAX_FLAGS = 32
MAX_DEPTH = 16


class Rule(NamedTuple):
    kind: str  # suffix, prefix, whole, around (both ends), pattern (its first match), everywhere (all matches) or rewrite
    inflected: str  # the affix, word or regular expression; of both ends, a prefix and a suffix with `BETWEEN`; else a name
    base: str | Callable  # what stands there instead; of a match; of a rewrite, the function of a text that gives it or None
    inner: tuple[str, ...] = ()
    outer: tuple[str, ...] = ()
    stem: str = ""  # of both ends: what stands between must be met by this as a whole, and becomes
    stem_base: str = ""  # this, if given


#: Parts the prefix and the suffix of a rule for both ends; no letter.
BETWEEN = "\u2026"


def suffix(inflected: str, base: str, inner: str = "", outer: str = "") -> Rule:
    return Rule("suffix", inflected, base, tuple(inner.split()), tuple(outer.split()))


def prefix(inflected: str, base: str, inner: str = "", outer: str = "") -> Rule:
    return Rule("prefix", inflected, base, tuple(inner.split()), tuple(outer.split()))


def whole(inflected: str, base: str, inner: str = "", outer: str = "") -> Rule:
    return Rule("whole", inflected, base, tuple(inner.split()), tuple(outer.split()))


def pattern(inflected: str, base: str | Callable[[re.Match], str], inner: str = "", outer: str = "") -> Rule:
    return Rule("pattern", inflected, base, tuple(inner.split()), tuple(outer.split()))


def everywhere(inflected: str, base: str, inner: str = "", outer: str = "") -> Rule:
    return Rule("everywhere", inflected, base, tuple(inner.split()), tuple(outer.split()))


def around(before: str, after: str, base_before: str, base_after: str, inner: str = "", outer: str = "", stem: str = "", stem_base: str = "") -> Rule:
    """A prefix and a suffix at once, either of which may be empty, around a stem of a certain form."""
    return Rule("around", before + BETWEEN + after, base_before + BETWEEN + base_after, tuple(inner.split()), tuple(outer.split()), stem, stem_base)


def rewrite(name: str, base: Callable[[str], str | None], inner: str = "", outer: str = "") -> Rule:
    return Rule("rewrite", name, base, tuple(inner.split()), tuple(outer.split()))


class Condition(NamedTuple):
    name: str
    members: tuple[str, ...] = ()
    dictionary_form: bool = True


class Form(NamedTuple):
    text: str
    flags: int
    trace: tuple[tuple[str, int, str], ...]  # latest first: transform, rule number in it, text it was applied to


@dataclass
class RuleSet:
    language: str
    conditions: list[Condition]
    transforms: dict[str, list[Rule]]
    flags: dict[str, int] = field(init=False)
    _affixes: dict = field(init=False, repr=False)
    _around: dict = field(init=False, repr=False)
    _patterns: list = field(init=False, repr=False)
    _rewrites: list = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.flags = self._allocate()
        self._affixes, self._around, self._patterns, self._rewrites = {}, {}, [], []
        place = 0
        for name, rules in self.transforms.items():
            for number, rule in enumerate(rules):
                entry = (place, name, number, rule, self.flags_of(rule.inner, strict=True), self.flags_of(rule.outer, strict=True))
                place += 1
                if rule.kind == "rewrite":
                    self._rewrites.append(entry)
                elif rule.kind in ("pattern", "everywhere"):
                    self._patterns.append((*entry, re.compile(rule.inflected, re.ASCII)))
                elif rule.kind == "around":
                    before, after = rule.inflected.split(BETWEEN)
                    self._around.setdefault(before, {}).setdefault(after, []).append((entry, re.compile(rule.stem, re.DOTALL) if rule.stem else None))
                else:
                    self._affixes.setdefault((rule.kind, rule.inflected), []).append(entry)

    def _allocate(self) -> dict[str, int]:
        flags: dict[str, int] = {}
        for c in self.conditions:
            if not c.members:
                flags[c.name] = 1 << len(flags)
        if len(flags) > MAX_FLAGS:
            raise ValueError(f"{self.language}: more than {MAX_FLAGS} conditions")
        groups = [c for c in self.conditions if c.members]
        while groups:
            left = [c for c in groups if any(m not in flags for m in c.members)]
            for c in groups:
                if c not in left:
                    flags[c.name] = 0
                    for m in c.members:
                        flags[c.name] |= flags[m]
            if len(left) == len(groups):
                raise ValueError(f"{self.language}: conditions {[c.name for c in left]} cannot be resolved")
            groups = left
        return flags

    def flags_of(self, names: Iterable[str], strict: bool = False) -> int:
        total = 0
        for n in names:
            if strict and n not in self.flags:
                raise ValueError(f"{self.language}: unknown condition {n}")
            total |= self.flags.get(n, 0)
        return total

    def part_of_speech_flags(self, names: Iterable[str]) -> int:
        """Of conditions that a dictionary may name; unknown names give none."""
        known = {c.name for c in self.conditions if c.dictionary_form}
        return self.flags_of(n for n in names if n in known)

    def rewrites(self, text: str) -> Iterator[tuple[tuple, str]]:
        """Rule entries that meet the text, in their order, and what they make of it."""
        found = []
        for size in range(len(text) + 1):
            for entry in self._affixes.get(("suffix", text[len(text) - size :]), ()):
                # An empty suffix is met everywhere; its rewrite leaves the base only.
                found.append((entry, (text[: len(text) - size] if size else "") + entry[3].base))
            for entry in self._affixes.get(("prefix", text[:size]), ()):
                found.append((entry, entry[3].base + text[size:]))
        for entry in self._affixes.get(("whole", text), ()):
            found.append((entry, entry[3].base))
        for size in range(len(text) + 1):
            for after, entries in self._around.get(text[:size], {}).items():
                if text.endswith(after) and size + len(after) <= len(text):
                    found += self._around_stem(text[size : len(text) - len(after)], entries)
        for *entry, compiled in self._patterns:
            if compiled.search(text):
                found.append((tuple(entry), compiled.sub(entry[3].base, text, count=entry[3].kind == "pattern")))
        found += ((entry, made) for entry in self._rewrites for made in [entry[3].base(text)] if made is not None)
        yield from sorted(found, key=lambda x: x[0][0])

    @staticmethod
    def _around_stem(stem: str, entries: list[tuple]) -> Iterator[tuple[tuple, str]]:
        for entry, form in entries:
            met = form.fullmatch(stem) if form else True
            if met:
                before, after = entry[3].base.split(BETWEEN)
                yield entry, before + (met.expand(entry[3].stem_base) if entry[3].stem_base else stem) + after

    def closure(self, text: str, max_depth: int = MAX_DEPTH) -> list[Form]:
        """The text and all forms that rules lead to, breadth first."""
        out = [Form(text, 0, ())]
        queue = deque(out)
        while queue:
            form = queue.popleft()
            if len(form.trace) >= max_depth:
                continue
            for (_, name, number, _, inner, outer), made in self.rewrites(form.text):
                if form.flags and not form.flags & inner:
                    continue
                if (name, number, form.text) in form.trace:
                    continue
                new = Form(made, outer, ((name, number, form.text), *form.trace))
                out.append(new)
                queue.append(new)
        return out
