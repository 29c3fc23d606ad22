"""Lines of a feed read into events: kind, who did it, to whom.

A reader holds the tables of one game. Words get a verdict (name, tag, word of
a notice, weapon, ...); a name by place is made of all words that stand for
names, a name in free text of the first one. A line is read by the first shape
it has: two names around a marker, digits beside a name, the owner of a
package, a banner of somebody's end, a notice, a bleed-out, a revival, or free
text. Names are the text's own; who they belong to is a look-up of its own
(``functions.names.resolve``).

The tests of a name are one list (``name_tests``) that a column expression and
the reader both go by.

Defined cases: null, empty and blank lines have no kind and no names; a line of
any length is read whole; both names equal regardless of letter case: neither
counts and the line has no kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import fixed as V
from feedloom.functions.text import TextRules, is_weapon, normalize_line, notice_kind, run_steps, weapon_pattern


@dataclass(frozen=True)
class NameTest:
    """``kind``: word (the whole name, in lower case), pattern (found in the lower-cased name), short or weapon."""

    kind: str
    value: object = None


def name_tests(rules: TextRules, by_place: bool) -> list[NameTest]:
    """What makes a text no name. By place only words of notices count and any number of words is fine."""
    events = set(V.EVENT_WORDS)
    words = events & set(V.NOTICE_WORDS) if by_place else events | {w.lower() for w in rules.common_words}
    tests = [
        NameTest("word", frozenset(V.BROADCAST_TAGS) | {c.lower() for c in rules.characters} | {"gun"} | words),
        NameTest("pattern", r"^(?=.{0,12}$).*icon"),
        NameTest("pattern", r"\[bleed|bleed\]|^\s*\[[^\]]*\]\s*$|^[.,/\-_=|:;]|[/<>\\|]|suggested$|spotted$|^[-_:@\s0-9]+$"),
        NameTest("weapon"),
        NameTest("short", V.LEAST_CERTAIN_NAME),
    ]
    return tests if by_place else [*tests, NameTest("pattern", r"\S\s+\S+\s+\S")]


def no_name(col: str | Column, rules: TextRules, by_place: bool = False) -> Column:
    """Whether a text is no name; null is none."""
    name = F.col(col) if isinstance(col, str) else col
    low = F.lower(name)
    out = name.isNull()
    for test in name_tests(rules, by_place):
        if test.kind == "word":
            out = out | F.trim(low).isin(sorted(test.value))
        elif test.kind == "pattern":
            out = out | low.rlike(test.value)
        elif test.kind == "weapon":
            out = out | is_weapon(name, rules)
        else:
            out = out | (F.length(name) < test.value)
    return F.coalesce(out, F.lit(True))


@dataclass(frozen=True)
class Word:
    written: str
    bare: str
    bracketed: bool


@dataclass
class Event:
    kind: str | None = None
    attacker: str | None = None
    victim: str | None = None
    by_place: bool = False
    digits: bool = False
    steps: list[str] = field(default_factory=list)


class Reader:
    """Reads lines with the tables of ``rules``; ``marker`` is the pattern of what stands between two names."""

    def __init__(self, rules: TextRules):
        self.rules = rules
        self.common = {w.lower() for w in rules.common_words}
        self.characters = {c.lower() for c in rules.characters}
        self.notices = set(V.NOTICE_WORDS)
        self.weapon = weapon_pattern(rules)
        self.marker = re.compile(rules.marker, re.IGNORECASE)
        self.tests = {place: name_tests(rules, place) for place in (False, True)}
        self.banner = re.compile(V.BANNER, re.IGNORECASE)

    @cached_property
    def tag(self) -> re.Pattern:
        return re.compile(r"[\[({|](?!DOWN\W)[A-Z0-9]{2,6}[\])}|]", re.IGNORECASE)

    # -- names -----------------------------------------------------------

    def is_weapon(self, text: str) -> bool:
        return bool(re.fullmatch(r"[0-9]{1,3}", text) or self.weapon.search(text.lower()))

    def no_name(self, text: str | None, by_place: bool) -> bool:
        if not text:
            return True
        low = text.lower()
        for test in self.tests[by_place]:
            if (
                (test.kind == "word" and low.strip() in test.value)
                or (test.kind == "pattern" and re.search(test.value, low))
                or (test.kind == "weapon" and self.is_weapon(text))
                or (test.kind == "short" and len(text) < test.value)
            ):
                return True
        return False

    def words(self, segment: str) -> list[Word]:
        out = []
        for written in re.findall(V.WORD, segment):
            bare = re.sub(r"[\[\]()]", "", written).strip(".,;:!?-_=|")
            out.append(Word(written, bare, bool(re.search(r"[\[\](){}]", written))))
        return out

    def verdict(self, word: Word) -> str:
        """What a word beside a marker is."""
        low = word.bare.lower()
        if not low:
            return "empty"
        if low in self.notices:
            return "notice"
        if "icon" in low and len(low) <= 12:
            return "marker"
        if self.is_weapon(word.bare):
            return "weapon"
        if low in self.characters:
            return "hidden name" if word.bracketed else "character"
        if word.bracketed and len(word.bare) <= 4:
            return "tag"
        return "name"

    def name_by_place(self, segment: str, tagged: bool = False, certain: bool = False) -> str | None:
        """All words of a segment that stand for a name. Its least length holds for the whole, and is less behind a tag."""
        if len(segment) < 3:
            return None
        judged = [(self.verdict(w), w) for w in self.words(segment)]
        name = " ".join(w.written if v == "hidden name" else w.bare for v, w in judged if v in ("name", "hidden name"))
        sure = certain or tagged or any(v == "tag" for v, _ in judged)
        least = V.LEAST_CERTAIN_NAME if sure else V.LEAST_NAME
        return name if len(re.sub(r"\s", "", name)) >= least else None

    def free_names(self, segment: str, steps: list[str] | None = None) -> list[str]:
        """Names in free text, word by word; one or two letters before a name are its beginning."""
        out: list[str] = []
        start = ""
        told = steps.append if steps is not None else lambda _: None
        for word in self.words(segment) if len(segment) >= 3 else []:
            bare, low = word.bare, word.bare.lower()
            if len(bare) < V.LEAST_NAME:
                start = bare if 1 <= len(bare) <= 2 and not word.bracketed and low not in self.common else ""
                told(f"word {word.written!r}: {'kept as a beginning' if start else 'too short'}")
            elif low in self.common:
                told(f"word {word.written!r}: common word")
            elif low in self.characters:
                if word.bracketed:
                    out.append(word.written)
                told(f"word {word.written!r}: {'hidden name' if word.bracketed else 'character'}")
            elif self.no_name(bare, False):
                start = ""
                told(f"word {word.written!r}: no name")
            else:
                out.append(start + bare if not word.bracketed else bare)
                told(f"word {word.written!r}: name {out[-1]!r}")
                start = ""
        return out

    # -- shapes ----------------------------------------------------------

    def segments(self, text: str) -> tuple[list[tuple[str, bool]], list[str]]:
        """((segment, behind a tag) around the markers, markers); without a marker three blanks part segments. A tag at the start of a segment is no marker."""
        out: list[tuple[str, bool]] = []
        marks: list[str] = []
        at, tagged = 0, False
        while True:
            rest = text[at:]
            start = at + len(rest) - len(rest.lstrip())
            tag = self.tag.match(text, start)
            if tag and text[tag.end() :].strip():
                at, tagged = tag.end(), True
            mark = self.marker.search(text, at)
            out.append((text[at : mark.start() if mark else len(text)].strip(), tagged))
            if not mark:
                break
            marks.append(mark[0])
            at, tagged = mark.end(), False
        if not marks and re.search(r"\s{3,}", text):
            return [(s.strip(), False) for s in re.split(r"\s{3,}", text)], []
        return out, marks

    @staticmethod
    def kind_of(mark: str) -> str:
        """Kind of a line by its last marker."""
        low = mark.lower()
        if re.search("ble+d", low):
            return "BleedOut"
        return "Knock" if re.search(r"gun|knock|down|\bdn\b", low) else "Kill"

    def pair(self, text: str) -> tuple[str, str] | None:
        """The names around the markers; of three or more names (rows read as one line) the last two."""
        parts, marks = self.segments(text)
        if len(parts) < 2:
            return None
        names = [n for s, tagged in parts if (n := self.name_by_place(s, tagged))]
        if len(names) == 1 and marks and not self.banner.search(text):
            sure = [n for s, tagged in parts if (n := self.name_by_place(s, tagged, certain=True))]
            names = sure if len(sure) >= 2 else names
        if len(names) < 2:
            return None
        return (names[-2], names[-1]) if len(names) >= 3 else (names[0], names[-1])

    def digit_pair(self, text: str) -> tuple[str, str] | None:
        """Around a single marker a name and four digits or more, in either order."""
        parts, marks = self.segments(text)
        if len(marks) != 1 or len(parts) != 2:
            return None
        sides = [run_steps(s, V.NAME_STEPS) for s, _ in parts]
        digits = [bool(re.fullmatch(r"[0-9]{4,}", s)) for s in sides]
        named = [not d and bool(s) and not self.no_name(s, False) for s, d in zip(sides, digits)]
        if any(digits) and any(named) and all(d or n for d, n in zip(digits, named)) and sides[0].lower() != sides[1].lower():
            return sides[0], sides[1]
        return None

    def cleaned(self, found: re.Match | None) -> str | None:
        """A name that a pattern found, without tags, if it is one."""
        name = run_steps(found[1], V.NAME_STEPS) if found else None
        return None if self.no_name(name, False) else name

    def listed(self, text: str) -> list[str]:
        """Names among all words of a line, for lines without marker."""
        out = []
        for word in re.findall(V.FREE_WORD, text):
            low = word.lower()
            if len(word) < V.LEAST_NAME or low in self.common:
                continue
            if re.match(r"\[.+\]", word):
                out.append(word)
            elif low not in self.characters and not self.no_name(word, False):
                name = run_steps(word, V.NAME_STEPS)
                if name and len(name) >= V.LEAST_NAME:
                    out.append(name)
        return out

    def without_character(self, name: str) -> str:
        """What follows a character's name that is glued to a name, unless it is four digits."""
        if not name.startswith("["):
            for who in self.rules.characters:
                rest = name[len(who) :]
                if name.lower().startswith(who.lower()) and rest and not re.fullmatch(r"[0-9]{4}", rest):
                    if len(rest) >= V.LEAST_NAME and not self.no_name(rest, False):
                        return rest
        return name

    def read(self, line: str | None, text: str | None, kind: str | None) -> Event:
        """``text`` is the normalized ``line``, ``kind`` what its words say (``text.notice_kind``)."""
        event = self._read(line or "", text or "", kind)
        for side in ("attacker", "victim"):
            name = getattr(event, side)
            if name and name != "You" and self.no_name(name, event.by_place) and not (event.digits and re.fullmatch("[0-9]{4,}", name)):
                setattr(event, side, None)
        if event.attacker and event.victim and event.attacker.lower() == event.victim.lower():
            return Event(steps=[*event.steps, "both names are equal"])
        return event

    def _read(self, line: str, text: str, kind: str | None) -> Event:
        low = text.lower()
        if re.search(V.PROMPT, low):
            return Event(steps=["prompt"])
        # Names keep their writing in the line itself; normalization only helps where it shows none.
        marks = self.segments(line)[1] or self.segments(text)[1]
        by_marker = self.kind_of(marks[-1]) if marks else "Knock"
        names = self.pair(line) or self.pair(text)
        if names and not any(self.no_name(n, True) for n in names):
            return Event(by_marker, *names, by_place=True, steps=["names around a marker"])
        if names := self.digit_pair(line):
            return Event(by_marker, *names, digits=True, steps=["digits beside a name"])
        if "care package" in low and "containing" in low:
            return Event("CarePackage", self.cleaned(re.search(V.PACKAGE_OWNER, text, re.IGNORECASE)), steps=["owner of a package"])
        if kind == "Eliminated" and (found := re.search(V.FELL, text, re.IGNORECASE)):
            name = re.sub(r"^(?:the\s+)?champion\s+", "", run_steps(found[1], V.NAME_STEPS), flags=re.IGNORECASE).strip()
            if not self.no_name(name, False):
                return Event("ChampionEliminated", None, name, steps=["banner of an end"])
        if kind in V.NO_VICTIM or kind == "PingLoot":
            return Event(kind, self._notifier(text, low, kind), steps=["notice"])
        if "bleed" in low and len(sides := re.split(V.BLEED_OUT, text, maxsplit=1, flags=re.IGNORECASE)) == 2:
            names = [self.name_by_place(s) for s in sides]
            return Event(kind, *(None if self.no_name(n, True) else n for n in names), by_place=True, steps=["bleed-out"])
        if kind == "Revive" and (found := re.search(V.REVIVED, text, re.IGNORECASE)):
            by = self.cleaned(re.search(V.REVIVER, text))
            return Event(kind, by or "You", self.cleaned(found), steps=["revival"])
        if marks and kind is None:
            placed = [(k, n) for k, (s, tagged) in enumerate(self.segments(line)[0]) if (n := self.name_by_place(s, tagged)) and not self.no_name(n, True)]
            if len(placed) == 1:
                k, name = placed[0]
                return Event(by_marker, *((name, None) if k == 0 else (None, name)), by_place=True, steps=["one name beside a marker"])
            return Event(steps=["no names around a marker"])
        names = [self.without_character(n) for n in self.listed(text)]
        if len(names) >= 2:
            return Event(kind, names[0], names[-1], steps=["free text"])
        return Event(kind, names[0] if names else None, steps=["free text"])

    def _notifier(self, text: str, low: str, kind: str) -> str | None:
        if "you" in low:
            return "You"
        if kind == "PingLoot":
            return self.cleaned(re.search(V.PINGER, text, re.IGNORECASE))
        return next(iter(self.listed(text)), None)

    def trace(self, line: str | None, text: str | None, kind: str | None) -> list[str]:
        """How a line is read, step by step."""
        steps = [f"line {line!r}", f"normal {text!r}" if text != line else "normal as it is"]
        parts, marks = self.segments(text or "")
        steps += [f"{len(marks)} markers" if marks else ("parts at blanks" if len(parts) > 1 else "one part")]
        for k, (segment, tagged) in enumerate(parts):
            steps.append(f"part {k} {segment!r}{' behind a tag' if tagged else ''}")
            if len(parts) > 1:
                steps += [f"word {w.written!r}: {self.verdict(w)}" for w in self.words(segment)]
            else:
                self.free_names(segment, steps)
        event = self.read(line, text, kind)
        return [*steps, *event.steps, f"{event.kind}: {event.attacker!r} -> {event.victim!r}"]


PARSED = "kind string, attacker string, victim string"


def parse_lines(lines: DataFrame, col: str, rules: TextRules) -> DataFrame:
    """``lines`` with canonical, event_type, attacker and victim. Normalization and the kind of a notice are columns, names an Arrow UDF."""

    @F.pandas_udf(PARSED)
    def read(raw: pd.Series, text: pd.Series, kind: pd.Series) -> pd.DataFrame:
        reader = Reader(rules)
        events = [reader.read(*x) for x in zip(raw, text, kind)]
        return pd.DataFrame([(e.kind, e.attacker, e.victim) for e in events], columns=["kind", "attacker", "victim"])

    out = lines.withColumn("canonical", normalize_line(col, rules)).withColumn("_read", read(col, "canonical", notice_kind("canonical")))
    return out.withColumns({"event_type": F.col("_read.kind"), "attacker": F.col("_read.attacker"), "victim": F.col("_read.victim")}).drop("_read")


def trace_lines(lines: DataFrame, col: str, rules: TextRules) -> DataFrame:
    """``lines`` with ``trace``, the steps of reading as an array of texts."""

    @F.pandas_udf("array<string>")
    def trace(raw: pd.Series, text: pd.Series, kind: pd.Series) -> pd.Series:
        reader = Reader(rules)
        return pd.Series([reader.trace(*x) for x in zip(raw, text, kind)])

    text = normalize_line(col, rules)
    return lines.withColumn("_text", text).withColumn("trace", trace(col, "_text", notice_kind("_text"))).drop("_text")


def names_by_place(col: str | Column, rules: TextRules, certain: bool = False) -> Column:
    """The name that a segment beside a marker holds."""

    @F.pandas_udf("string")
    def name(segments: pd.Series) -> pd.Series:
        reader = Reader(rules)
        return pd.Series([reader.name_by_place(s or "", certain=certain) for s in segments], dtype="object")

    return name(col)


def names_in_text(col: str | Column, rules: TextRules) -> Column:
    """All names in free text."""

    @F.pandas_udf("array<string>")
    def names(texts: pd.Series) -> pd.Series:
        reader = Reader(rules)
        return pd.Series([reader.free_names(s or "") for s in texts])

    return names(col)


def pair_of_names(col: str | Column, rules: TextRules, digits: bool = False) -> Column:
    """struct(attacker, victim) around the markers of a line; ``digits``: of a name and digits."""

    @F.pandas_udf("attacker string, victim string")
    def pair(texts: pd.Series) -> pd.DataFrame:
        reader = Reader(rules)
        found = [(reader.digit_pair if digits else reader.pair)(s or "") or (None, None) for s in texts]
        return pd.DataFrame(found, columns=["attacker", "victim"], dtype="object")

    return pair(col)
