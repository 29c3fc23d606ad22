"""Sentence units of documents in all scripts.

The character properties of the Unicode sentence-break rules decide what can
end a sentence (STerm, ATerm), what closes it (Close), what continues it
(SContinue, Lower) and what starts one (Upper, OLetter). They are tailored by
 - abbreviations in classes: never last in a sentence (titles, "e.g."), not
   last before a number ("no. 5"), and possibly last ("etc."), when an upper
   case start decides; by language, which the frequent words of the sentence
   tell, else those of the text, else ``lang`` (it is often wrong and texts mix
   languages): a word that is ordinary there abbreviates nothing;
 - quotations and brackets: what they enclose belongs to the sentence around
   them, which ends behind the closing mark if no lower-case or quotative
   continuation follows;
 - identifiers, links and inline code, which may start a sentence in lower case;
 - Thai, where a blank after Thai text ends the sentence;
 - Markdown: blank lines end sentences, list and quote marks belong to the next
   one, fenced code has none.

Defined cases: a null or empty text has no sentence, nor has one of blanks,
marks or code only; an unclosed fence runs to the end; unmatched quotes and
brackets are ordinary characters; texts of any length are read whole, in
linear time; line ends may be of any kind.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Abbreviations:
    """Words that a period abbreviates: never last in a sentence, not last before a number, possibly last."""

    never: frozenset[str]
    number: frozenset[str]
    maybe: frozenset[str]

    def __or__(self, more: Abbreviations) -> Abbreviations:
        return Abbreviations(self.never | more.never, self.number | more.number, self.maybe | more.maybe)


def _listed(never: str, number: str, maybe: str) -> Abbreviations:
    return Abbreviations(*(frozenset(words.split()) for words in (never, number, maybe)))


# Abbreviations by language (fixed public knowledge).
ABBREVIATIONS = {
    "en": _listed(
        "mr mrs ms dr prof st messrs hon rev gen col capt lt sgt sen rep gov pres supt e.g i.e cf esp approx vs viz resp incl ca",
        "no nos nr num fig figs sec secs ch chap vol p pp pg v ver eq ed para jan feb mar apr jun jul aug sep sept oct nov dec",
        "etc et.al al inc ltd corp co bros llc plc jr esq a.m p.m am pm u.s u.k u.n e.u min max hrs hr sec secs ave blvd rd std dept est tel",
    ),
    "de": _listed(
        "dr prof st hr fr herr dipl bzw d.h z.b z.t v.a ggf evtl sog bspw vgl inkl exkl zzgl ugs ca resp vs",
        "nr nrn num abs bd kap ziff anm abb art s fig tab vol p v ver jan feb mär apr jun jul aug sep sept okt nov dez",
        "usw u.a u.ä o.ä etc std gmbh co min max tel al inc ltd",
    ),
    "fr": _listed(
        "mme mlle dr prof st env p.ex cf vs",
        "n° nº nos num art arts chap p pp fig figs vol tab v ver éd janv févr avr juil sept oct nov déc",
        "etc al cie min max tél inc ltd",
    ),
    "es": _listed(
        "sr sra srta srs dr dra prof dña aprox ej p.ej av ud uds vd vds cf vs",
        "núm nº art arts cap caps pág págs p pp fig figs vol v ver tab ene feb mar abr jun jul ago sep sept oct nov dic",
        "etc a.m p.m cía min max tel al inc ltd",
    ),
    "it": _listed("sig sigra dott prof avv dr ca cf p.es", "n nº num art artt cap pag pagg p pp fig figg vol tab v ver", "etc ecc min max tel al"),
}
#: Of scripts that share no letters with the languages above, so that they need no choice of a language.
OTHER_SCRIPTS = _listed(
    "см т.е напр им ул г-н д-р проф тов डॉ श्री श्रीमती प्रो पं कु सं د أ م", "рис гл стр табл п пп ст илл разд", "т.д т.п др пр сек мин час руб тыс млн млрд г гг в вв"
)
#: Frequent words that tell the language of a text in Latin letters (fixed public knowledge).
FREQUENT = {
    "en": "the and of to is in it that for was with this you on are not have be my i but from when after",
    "de": "der die das und ist nicht ich ein eine mit den auf es dass im zu von wird wenn aber auch bei nach sich",
    "fr": "le la les des et est une dans pas que je pour du il qui sur avec mais au ne ce plus après",
    "es": "el la los las y es una en no que yo para del con por pero se un al lo más cuando después",
    "it": "il la gli le e è una in non che io per del con ma si un al lo più quando dopo di",
}
_TOLD = {word: [lang for lang, words in FREQUENT.items() if word in words.split()] for words in FREQUENT.values() for word in words.split()}
_ALL = reduce(Abbreviations.__or__, ABBREVIATIONS.values()) | OTHER_SCRIPTS
_BY_LANGUAGE = {lang: words | OTHER_SCRIPTS for lang, words in ABBREVIATIONS.items()}
#: What abbreviates in one language and is an ordinary word of another (fixed public knowledge).
ORDINARY = {
    "en": frozenset("app art arts tab cap abs ill nos n ed".split()),
    "de": frozenset("am in no est es al ex".split()),
    "fr": frozenset("est no es des sec mars".split()),
    "es": frozenset("no para al es e mar".split()),
    "it": frozenset("no al e in es mar".split()),
}


_SOMEWHERE_ORDINARY = frozenset().union(*ORDINARY.values())


def _told(words: list[str]) -> list[str]:
    """The languages that most of the frequent words among ``words`` tell."""
    votes = Counter(lang for word in words for lang in _TOLD.get(word, ()))
    most = max(votes.values(), default=0)
    return [lang for lang, n in votes.items() if n == most]


class Language:
    """Which abbreviations hold in a sentence of a text. Texts mix languages, so the sentence itself tells its language.

    All lists hold, but for a word that is an ordinary one in the language of the sentence; then only the list of that
    language does. It is asked for such words only: the frequent words of the sentence before the word tell it, those of
    the whole text or ``lang`` only where they leave several.
    """

    def __init__(self, text: str, lang: str | None = None):
        self.text, self.lang = text, (lang or "").strip().lower()[:2]

    @cached_property
    def of_text(self) -> list[str]:
        told = _told(self.text.lower().split())
        return told if len(told) == 1 else [self.lang]

    def known(self, word: str, low: int, at: int) -> Abbreviations:
        if word in _SOMEWHERE_ORDINARY:
            told = _told(self.text[low:at].lower().split()[:-1])
            if len(told) > 1:
                told = [lang for lang in told if lang in self.of_text]
            if told and word in ORDINARY[told[0]]:
                return _BY_LANGUAGE[told[0]]
        return _ALL


#: Behind a number these are units and no titles.
UNITS = frozenset(["ms", "hr", "hrs", "st", "m", "mm"])
DAYS = set(
    "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun "
    "january february march april may june july august september october november december "
    "est cst mst pst edt cdt mdt pdt utc gmt cet cest".split()
)
GERMAN_BEFORE_ORDINAL = set(
    "am der die das den dem des vom zum zur im beim ab bis seit jede jeder jedes jeden unser unsere mein meine ihre seine dieser diese".split()
)
GERMAN_MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
JAPANESE_GO_ON = ("と", "って", "という", "などと")
CHINESE_GO_ON = ("然后", "随后", "接着", "就", "并", "而", "便", "地", "的", "后", "说", "道")

#: Words that go on behind a quotation in scripts without letter case.
GO_ON_WORDS = set("और फिर तो लेकिन तथा कहकर पर बोला कहा ثم و لكن قال فقال وقال حسب بل".split())

_FENCE = regex.compile(r"(?:\A|(?<=[\r\n\u2028\u2029\u0085]))[ \t>]*(?:[-*+] )?```[^\r\n]*")
_BLANK = regex.compile(r"(?>\r\n|[\n\r\u2028\u0085])[ \t\u00a0\u3000>]*(?=[\r\n\u2028\u0085])|\u2029")
_LINE_MARK = regex.compile(r"(?:[ \t　]*(?:>|[-*+•‣·–](?=[ \t　])|\(?\d{1,3}[.)](?=[ \t　])|#{1,6}(?=[ \t])))*[ \t　]*")
_LINES = "\r\n \u0085"
_LINE_BREAK = regex.compile(f"\r\n|[{_LINES}]")
_FULL = "。！？｡．"
_TERM = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…]+")
_CLOSE = regex.compile(r"[\p{SB=Close}--\p{Ps}]*", regex.V1)
_SPACED_CLOSE = regex.compile(r"[   ]?»")
_GAP = regex.compile(r"[\s​]*")
_THAI = regex.compile(r"\p{Script=Thai}")
_THAI_GAP = regex.compile(r"(?<=\S)\s+(?=\S)")
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}.ºª°\-]+")
_TWO_BEFORE = regex.compile(r"(?r)(\S+)\s+\S+")
_NEXT_TOKEN = regex.compile(r"\S+")
_OPENERS = regex.compile(r"[\p{Ps}\p{Pi}\"'¿¡„‚]+")
_IDENTIFIER = regex.compile(r"`|\w*[_\d]|[\p{Ll}]+\p{Lu}|\w+[./\\:(]\w|\w+://|\w+\(\)")
_ONLY_MARKS = regex.compile(r"(?:[>\-*+•‣·–#\s]|(?<!\S)\d{1,3}[.)](?!\S))*")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "«": "»", "„": "“", "“": "”"}
_MARKS = regex.compile(r"[()\[\]{}（）「」『』【】《》〈〉«»„“”\"]")
_GOES_ON = regex.compile(r"\p{SB=SContinue}|\p{L}")
_BREAKS_OFF = regex.compile(r"[,;:，、；：)\]]|[-–—] \p{Ll}")
_UPPER, _LOWER, _NUMERIC = (regex.compile(rf"\p{{SB={c}}}") for c in ("Upper", "Lower", "Numeric"))
_INITIAL = regex.compile(r"\p{Latin}|\p{Cyrillic}|\p{Greek}")


def _enclosed(text: str, low: int, high: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Outermost spans (open, behind close) of matched quotes and brackets, and where any matched one is closed."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text, low, high):
        ch, at = m[0], m.start()
        if ch == '"':
            inside = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            before = text[at - 1] if at > low else " "
            if inside is None:
                if before.isspace() or before in "([{（「:：“„«-–—=,>" or not before.isascii():
                    stack.append(('"', at))
                continue
            closes = inside
        else:
            closes = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == ch), None)
            if closes is None:
                if ch in _PAIRS:
                    stack.append((_PAIRS[ch], at))
                continue
        spans.append((stack[closes][1], at + 1))
        del stack[closes:]
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            continue
        out.append((a, b))
    return out, {b for _, b in spans}


def _abbreviation(text: str, low: int, at: int) -> str:
    """Word before the period at ``at`` in lower case, with the letters of 'z. B.' put together."""
    m = _WORD_BEFORE.match(text, low, at)
    if not m:
        return ""
    word = m[0].lower().strip(".")
    if len(word.rpartition(".")[2]) <= 2 and "." not in word:
        k = m.start()
        while k > low and text[k - 1].isspace():
            k -= 1
        if m.start() > k > low + 1 and text[k - 1] == "." and text[k - 2].isalpha() and (k - 2 == low or not text[k - 3].isalnum()):
            return f"{text[k - 2].lower()}.{word}"
    return word


def _before(text: str, low: int, at: int) -> str:
    """The word before the last one before ``at``, in lower case."""
    two = _TWO_BEFORE.match(text, low, at)
    return two[1].lower() if two else ""


def _next(text: str, at: int, high: int) -> int:
    """Where the text goes on after blanks and, on a new line, list and quote marks."""
    k = _GAP.match(text, at, high).end()
    if any(c in _LINES for c in text[at:k]):
        k = _LINE_MARK.match(text, k, high).end()
    return k


def _starts(text: str, k: int, high: int) -> str:
    """Kind of start at ``k``: upper, lower, digit, name (identifier, code or link) or other."""
    m = _OPENERS.match(text, k, high)
    if m and m.end() < high:
        k = m.end()
    if k >= high or text[k].isspace():
        return "other"
    ch = text[k]
    if _UPPER.match(ch):
        return "upper"
    if _NUMERIC.match(ch):
        return "digit"
    lower = _LOWER.match(ch)
    if ch == "`" or (lower and _IDENTIFIER.match(text, k, high)):
        return "name"
    return "lower" if lower else "other"


def _ends(text: str, low: int, term: regex.Match, high: int, closes: set[int], language: Language) -> int:
    """End of the sentence that the terminators ``term`` end, or 0. Quotations are closed at ``closes``."""
    marks, at = term[0], term.end()
    closed = _CLOSE.match(text, at, high).end()
    spaced = _SPACED_CLOSE.match(text, closed, high)
    if spaced and spaced.end() in closes:
        closed = spaced.end()
    if closed == high:
        return closed
    full = marks[-1] in _FULL
    if not text[closed].isspace():
        if not full:
            # Other scripts' own terminators need no blank.
            return closed if marks[-1] not in ".!?…․" and not _GOES_ON.match(text, closed) else 0
        if text[closed] in "，、；：,;:":
            return 0
        if closed > at and text.startswith(JAPANESE_GO_ON + CHINESE_GO_ON, closed):
            return 0
        return closed
    k = _next(text, closed, high)
    if k >= high:
        return closed
    kind = _starts(text, k, high)
    if closed > at and kind == "lower":
        return 0
    if closed > at and kind == "other":
        if full and text.startswith(JAPANESE_GO_ON + CHINESE_GO_ON, k):
            return 0
        if _NEXT_TOKEN.match(text, k, high)[0].strip(".,،।;:") in GO_ON_WORDS:
            return 0
    if _BREAKS_OFF.match(text, k, high):
        return 0
    if marks in ("...", "…", "……", "....") or marks.endswith("..."):
        return 0 if kind == "lower" else closed
    if marks[-1] != ".":
        return closed
    if closed > at:
        return closed
    word = _abbreviation(text, low, term.start())
    bare = word.rpartition("-")[2]
    known = language.known(bare, low, term.start())
    unit = word in UNITS and _before(text, low, term.start())[-1:].isdigit()
    if word in known.never and not unit:
        return 0
    if word.isdigit():
        if kind == "upper" and len(word) <= 3:
            follows = _NEXT_TOKEN.match(text, k, high)[0].lower().strip(".,;:!?")
            if follows in GERMAN_MONTHS or _before(text, low, term.start()) in GERMAN_BEFORE_ORDINAL:
                return 0
        return 0 if kind == "lower" else closed
    if bare in known.number and kind == "digit":
        return 0
    if unit or word in known.maybe or bare in known.maybe:
        if kind in ("lower", "digit"):
            return 0
        if kind == "upper" and (word in ("a.m", "p.m", "am", "pm")):
            follows = _NEXT_TOKEN.match(text, k, high)[0].lower().strip(".,;:!?)")
            return 0 if follows in DAYS else closed
        return closed
    if len(word) == 1 and word.isalpha() and word.islower():
        letter = text[term.start() - 1]
        before = text[max(low, term.start() - 3) : term.start() - 1].strip()
        if before[-1:].isdigit():  # a unit
            return 0 if kind == "lower" else closed
        if letter.isupper() and letter != "I" and _INITIAL.match(letter):
            return 0
        if kind != "upper" or letter.islower() and word.isascii():
            return 0
    if "." in word and len(word) == 3 and word[0].isalpha() and word[2].isalpha():
        return 0 if kind in ("lower", "digit", "name") else closed
    return 0 if kind == "lower" else closed


def _piece(text: str, low: int, high: int, language: Language, out: list[int]) -> None:
    """Ends of the sentences in a piece without blank lines or code."""
    while high > low and text[high - 1].isspace():
        high -= 1
    while low < high and text[low].isspace():
        low += 1
    if _ONLY_MARKS.fullmatch(text, low, high):
        return
    body = _LINE_MARK.match(text, low, high).end()
    spans, closes = _enclosed(text, low, high)
    lines = [low, *(m.end() for m in _LINE_BREAK.finditer(text, low, high))]
    ends: list[int] = []
    s = 0
    for term in _TERM.finditer(text, body, high):
        follows = text[term.end()] if term.end() < high else " "
        if follows.isalnum() and term[0][-1] in ".!?…":
            continue  # a decimal, a name or a link
        while s < len(spans) and spans[s][1] <= term.start():
            s += 1
        at = term.start()
        if s < len(spans) and spans[s][0] < at and spans[s][1] > _CLOSE.match(text, term.end(), high).end():
            tail = text[term.end() : spans[s][1]]
            if tail.strip("   ") != tail[-1:]:
                continue  # enclosed, and not at the end of what encloses it
        if ends and at < ends[-1]:
            continue
        if term[0] == "." and at > low and text[at - 1].isdigit():
            line = lines[bisect_right(lines, at) - 1]
            if _LINE_MARK.match(text, line, high).end() > at:
                continue  # the mark of a list
        end = _ends(text, ends[-1] if ends else body, term, high, closes, language)
        if end:
            ends.append(end)
    if not ends or ends[-1] < high:
        ends.append(high)
    if _THAI.search(text, low, high):
        ends = _with_thai_gaps(text, body, high, ends)
    out.extend(ends)


def _with_thai_gaps(text: str, low: int, high: int, ends: list[int]) -> list[int]:
    cuts: list[int] = []
    start = low
    for end in ends:
        for gap in _THAI_GAP.finditer(text, start, end):
            k = _next(text, gap.start(), end)
            if k < end and gap.start() >= start and _THAI.search(text, start, gap.start()):
                cuts.append(gap.start())
                start = k
        cuts.append(end)
        start = end
    return cuts


def sentence_ends(text: str | None, lang: str | None = None) -> list[int]:
    """Code points from the start of ``text`` to the end of each of its sentences."""
    if not text:
        return []
    language = Language(text, lang)
    out: list[int] = []
    fences = list(_FENCE.finditer(text))
    prose, at = [], 0
    for k in range(0, len(fences), 2):
        prose.append((at, fences[k].start()))
        at = fences[k + 1].end() if k + 1 < len(fences) else len(text)
    prose.append((at, len(text)))
    for low, high in prose:
        for blank in _BLANK.finditer(text, low, high):
            if blank.start() >= low:
                _piece(text, low, blank.start(), language, out)
                low = blank.end()
        _piece(text, low, high, language, out)
    return out


def _ends_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "ends": [sentence_ends(t, g) for t, g in zip(pdf["text"], pdf["lang"])]})


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        texts: list[str] = []
        for doc, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
            low = 0
            for end in sentence_ends(text, lang):
                while text[low].isspace():
                    low += 1
                ids.append(doc)
                starts.append(low)
                ends.append(end)
                texts.append(text[low:end])
                low = end
        if ids:
            yield pd.DataFrame({"doc_id": ids, "char_start": starts, "char_end": ends, "sentence": texts})


def _with_lang(documents: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.select("doc_id", "text", lang.alias("lang"))


def sentence_boundaries(documents: DataFrame) -> DataFrame:
    """(doc_id, char_end): the ends alone, without the texts of the sentences."""
    ends = _with_lang(documents).mapInPandas(_ends_of_batches, "doc_id long, ends array<long>")
    return ends.select("doc_id", F.explode("ends").alias("char_end"))


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, char_start, char_end, sentence). Behind fenced code a sentence starts with the code."""
    return _with_lang(documents).mapInPandas(_split_batches, "doc_id long, char_start long, char_end long, sentence string")
