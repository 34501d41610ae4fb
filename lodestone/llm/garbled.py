"""Texts garbled by a wrong decoding: find them and restore the original.

A hidden Markov model labels the characters of a text.  It has one clean state, one state per encoding pair (the bytes of
encoding ``right`` were read as encoding ``wrong``), one for characters lost for good (U+FFFD) and one for passages that only
show garbled characters ("the pair Ã¼ turns up").  In a pair's state the emission is one *code unit*: the characters that the
wrong decoding made of one original character.

Emissions are character bigrams, fitted on all clean rows by language (``fit``): a path costs the negative
logarithm of the probability of the text it restores, so the clean path costs that of the text as it stands.  A lost
character stands for any non-ASCII one.  A shown unit stands for itself between characters that are no letters.  Viterbi's
path labels the text, and each labelled unit gets its state's inverse transform.  What comes out is labelled again, up to
three times; a restoration that is still garbled then counts as none, and units that restore nothing likely are no units.

The fit is Viterbi training: a prior (``SEED``) labels the rows, the clean ones are counted, and the model of these labels
them again.
Between ASCII characters a text's non-ASCII runs meet the same neighbours in every state, so each run is scored once, the
scores are kept, and the path over the runs of a text is exact. No filter comes before it but that a text has to have
non-ASCII characters.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoding pairs (right, wrong, number of times), each a state of the model.
PAIRS = (
    ("utf-8", "cp1252", 1),
    ("utf-8", "latin-1", 1),
    ("utf-8", "cp1252", 2),
    ("utf-8", "latin-1", 2),
    ("utf-8", "cp1252", 3),
    ("utf-8", "latin-1", 3),
    ("utf-8", "cp437", 1),
    ("utf-8", "cp850", 1),
    ("utf-8", "mac_roman", 1),
    ("utf-8", "cp1250", 1),
    ("utf-8", "cp1251", 1),
    ("utf-8", "cp1253", 1),
    ("utf-8", "cp1254", 1),
    ("utf-8", "iso8859-2", 1),
    ("utf-8", "iso8859-15", 1),
    ("utf-8", "koi8_r", 1),
    ("utf-8", "cp866", 1),
    ("utf-8", "gbk", 1),
    ("cp1252", "cp437", 1),
    ("cp1252", "cp850", 1),
    ("cp1252", "mac_roman", 1),
    ("cp1252", "cp1250", 1),
    ("cp1252", "cp1251", 1),
    ("cp1250", "cp1252", 1),
    ("cp437", "cp1252", 1),
    ("cp850", "cp1252", 1),
    ("mac_roman", "cp1252", 1),
    ("cp1251", "cp1252", 1),
    ("koi8_r", "cp1252", 1),
    ("cp866", "cp1252", 1),
    ("cp1251", "koi8_r", 1),
    ("koi8_r", "cp1251", 1),
    ("cp1251", "cp866", 1),
    ("cp866", "cp1251", 1),
    ("shift_jis", "cp1252", 1),
    ("euc_jp", "cp1252", 1),
    ("gbk", "cp1252", 1),
)
#: States in which control characters may have been stripped, or replaced by U+FFFD, after the wrong decoding.
STRIPPED = (0, 1)
LOST, SHOWN = len(PAIRS), len(PAIRS) + 1

#: Transitions, in negative logarithms: entering a state of many-byte or one-byte units, that of lost or shown ones; leaving
#: one; a clean character amid units; a unit, a shown one in quotation marks or apart,
#: a shown character, U+FFFD shown, and remains of a unit. A restored character may cost so much on average; so many
#: originals of a lost character are kept.
ENTER, ENTER_SINGLE, ENTER_MANY, ENTER_LOST, ENTER_SHOWN, LEAVE = 8.0, 11.0, 60.0, 7.0, 8.0, 3.0
MIXED, UNIT, QUOTED, APART, SINGLE, MARK, REMAINS = 5.0, 0.1, 3.0, 7.0, 7.5, 5.0, 4.0
PLAUSIBLE, LAYERS, WIDTH = 8.5, 3, 12
#: The weight of a text of SEED against so many rows of a larger table, and the rounds of the fit.
RATE, SEED_WEIGHT, ROUNDS = 10_000, 4, 2
#: Smoothing (Witten-Bell, from languages to all to kinds): a bigram must occur in more than this share of
#: the texts; the probability of capitals against that of small letters.
SHARE, CAPITALS = 0.0002, 0.4

#: A published declaration's first article and signs where they are at home; the fit's prior, so that a small table has one.
SEED = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. “It’s the café’s,” she said – or didn’t she? – for 20 € or £5… ‘So’ it was — at 3 °C.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. « À l’été, où ça ? » Le cœur naïf, Noël, la forêt, dès août : 20 €… l’École est là. Çà et là. Être, Île, Ô.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. „Größe“, Äpfel, Öl, Übung, für, schön, Straße, März – 20 € am Gebäude…",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. ¿Qué año? ¡Sí, mañana! «Él llegó después, según el pingüino – aquí», a 20 €. Árbol, Útil, Óscar, el 1.º y la 2.ª.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Não há três mães à tarde; é avó, avô, você, ação e ações, pêssego, também, público. À noite. Água, Ética.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. È così, perché può già; però più lunedì: cioè l’età è là.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. «Ещё раз, – сказал он, – это я и ты». Она в саду, у дома, с книгой, к обеду, о чём? А где подъезд, жюри, цех, фильм, щука, шум, эхо?",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。「カフェとノート」と言った。",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Źródło, żółć, łąka, kość, ćma, więź.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Žižka a Čapek šli přes řeku; kůň, ťuk, ďas.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
}

_NON = r"[^\x00-\x7f]"
#: Signs that quote.
QUOTES = frozenset("\"'`“”‘’«»„")


def _byte_of(wrong: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding, bytes without a character standing for the control characters of the same number."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(wrong)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


def _class(table: dict[str, int], low: int, high: int, more: str = "") -> str:
    import regex

    return "[" + more + "".join(regex.escape(c) for c, b in table.items() if low <= b <= high) + "]"


#: Marks the likeliest original of a character that cannot be told for sure.
TORN = "\0"
Unit = tuple[int, int, str]


class _Pair:
    """Finds the units of one encoding pair in a text: (start, end, original)."""

    def __init__(self, right: str, wrong: str, times: int):
        import regex

        self.right, self.wrong, self.times = right, wrong, times
        self.enter = ENTER_MANY if right in ("shift_jis", "euc_jp", "gbk") else ENTER_SINGLE if right != "utf-8" else ENTER
        self.form = "run" if wrong == "gbk" else "utf-8" if right == "utf-8" else "many" if right in ("shift_jis", "euc_jp", "gbk") else "one"
        if self.form == "run":
            self.pattern = regex.compile(rf"(?:{_NON}[@-~]?)+")
            return
        self.table = _byte_of(wrong)
        if self.form != "utf-8":
            self.table = {chr(b): b for b in range(0x80, 0xA0)} | self.table
        if self.form == "one":
            read = {c: bytes([b]).decode(right, "ignore") for c, b in self.table.items()}
            self.map = {c: made for c, made in read.items() if made > "\x9f" and made != c}
            self.same = frozenset(c for c, made in read.items() if made == c)
        elif self.form == "utf-8":
            tail = _class(self.table, 0x80, 0xBF)
            # leads of two-byte characters: Latin, modifiers, combining marks, Greek, Cyrillic, Hebrew, Arabic
            two = f"(?:{_class(self.table, 0xC2, 0xC6)}|{_class(self.table, 0xCB, 0xD1)}|{_class(self.table, 0xD7, 0xD9)}){tail}"
            self.pattern = regex.compile(f"{two}|{_class(self.table, 0xE0, 0xEF)}{tail}{{2}}|{_class(self.table, 0xF0, 0xF4)}{tail}{{3}}")
            kept = _class({c: b for c, b in self.table.items() if not "\x7f" < c < "\xa0"}, 0x80, 0xBF, "\ufffd")
            self.remains = regex.compile(f"({two[: -len(tail)]}|{_class(self.table, 0xE0, 0xEF)}|{_class(self.table, 0xF0, 0xF4)})({kept}{{0,3}})")

    def _once(self, text: str) -> list[Unit]:
        found: list[Unit] = []
        if self.form == "one":
            return [(i, i + 1, self.map[c]) for i, c in enumerate(text) if c in self.map]
        if self.form == "run":
            for m in self.pattern.finditer(text):
                for end in (m.end(), m.end() - 1):  # an ASCII character at the end may be the text's own
                    try:
                        if made := text[m.start() : end].encode("gbk").decode("utf-8"):
                            found.append((m.start(), end, made))
                            break
                    except UnicodeError:
                        pass
            return found
        if self.form == "many":
            i = 0
            while i < len(text):
                if text[i] not in self.table:
                    i += 1
                    continue
                for n in (2, 3):
                    try:
                        made = bytes(self.table.get(c, ord(c) if c < "\x80" else 256) for c in text[i : i + n]).decode(self.right)
                    except ValueError:
                        continue
                    if len(made) == 1 and i + n <= len(text):
                        found.append((i, i + n, made))
                        i += n
                        break
                else:
                    i += 1
            return found
        for m in self.pattern.finditer(text):
            try:
                found.append((m.start(), m.end(), bytes(self.table[c] for c in m[0]).decode("utf-8")))
            except UnicodeDecodeError:
                pass
        return found

    def keeps(self, text: str) -> bool:
        """Whether the wrong decoding leaves a text as it is."""
        return self.form == "one" and all(c < "\x80" or c in self.same for c in text)

    def units(self, text: str) -> list[Unit]:
        found = self._once(text)
        for _ in range(self.times - 1):
            if not found:
                break
            made, at, pos = [], [], 0
            for s, e, c in found:
                made += text[pos:s] + c
                at += [(i, i + 1) for i in range(pos, s)] + [(s, e)]
                pos = e
            made += text[pos:]
            at += [(i, i + 1) for i in range(pos, len(text))]
            found = [(at[s][0], at[e - 1][1], c) for s, e, c in self._once("".join(made)) if sum(b - a for a, b in at[s:e]) > e - s]
        return found

    def torn(self, text: str, found: list[Unit], known: tuple[str, ...]) -> list[Unit]:
        """Remains of units whose control characters were stripped, made blanks or replaced, where there is no whole unit: one
        for each known character of which they may be."""
        whole: set[int] | None = None
        made: list[Unit] = []
        for m in self.remains.finditer(text):
            whole = {i for a, b, _ in found for i in range(a, b)} if whole is None else whole
            for n in range(len(m[2]) + 1):
                if whole.isdisjoint(range(m.start(), m.start() + 1 + n)):
                    made += [(m.start(), m.start() + 1 + n, TORN + c) for c in self._originals(m[1] + m[2][:n], known)]
        return made

    @lru_cache(maxsize=10_000)  # noqa: B019
    def _originals(self, seen: str, known: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(c for c in known if self._may_be(c, seen))

    def _may_be(self, c: str, seen: str) -> bool:
        """Whether the seen characters are those of c without some of the control characters."""
        want = c.encode("utf-8")
        if want[0] != self.table[seen[0]] or len(want) <= len(seen) and "\ufffd" not in seen:
            return False
        at = 1
        for x in seen[1:]:
            if x == "\ufffd":
                at += 1
                continue
            while at < len(want) and want[at] != self.table[x] and want[at] <= 0xA0:
                at += 1
            if at >= len(want) or want[at] != self.table[x]:
                return False
            at += 1
        return at <= len(want) and all(b <= 0xA0 for b in want[at:])


@lru_cache(maxsize=1)
def _pairs() -> tuple[_Pair, ...]:
    return tuple(_Pair(*p) for p in PAIRS)


@lru_cache(maxsize=1)
def _patterns():
    import regex

    run = regex.compile(rf"{_NON}(?:{_NON}|[@-~](?={_NON}))*[@-~]?")
    own = regex.compile("[^\\u0000-\\u024f\\u0370-\\u052f\\u2000-\\u22ff\\u2500-\\u259f\\u3000-\\u30ff]")
    return run, own, regex.compile(_NON)


#: A space after a digit, in the table of bigrams.
AFTER_DIGIT = "\x1e"


@lru_cache(maxsize=65536)
def kind(c: str) -> str:
    """Kind of a character: ASCII ones for themselves but digits, others by script, case and general category."""
    if c < "\x80":
        return "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c
    if c == "\ufffd":
        return "X"
    o, category = ord(c), unicodedata.category(c)
    if 0xE000 <= o <= 0xE0FE:
        return chr(o - 0xE000)
    if 0x3000 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xFF00 <= o <= 0xFFEF:
        return "J"
    if category[0] == "L":
        script = "L" if o <= 0x24F else "G" if o < 0x400 else "K" if o <= 0x52F else "H" if 0xAC00 <= o <= 0xD7A3 else "Q"
        return script if category == "Lu" else script.lower()
    if category[0] in "CM":
        return "m" if category[0] == "M" else "x"
    return "b" if 0x2500 <= o <= 0x259F else "p" if category[0] == "P" else "s" if category[0] == "Z" else "y" if o < 0x2300 else "r"


#: About how many characters a kind has, for those the rows do not hold.
_SIZES = defaultdict(lambda: 100.0, {"J": 1000.0, "H": 1000.0, "Q": 60.0, "q": 60.0, "r": 1000.0, "k": 40.0, "K": 40.0, "g": 40.0, "G": 40.0})


def symbols(text: str) -> str:
    """A text with digits as 0, a space after a digit as a sign of its own, and characters of large scripts as one symbol per kind."""
    text = _DIGITS.sub("0", text).replace("0 ", "0" + AFTER_DIGIT)
    return text if text.isascii() else _patterns()[1].sub(lambda m: chr(0xE000 + ord(kind(m[0]))), text)


_DIGITS = re.compile("[1-9]")


@lru_cache(maxsize=65536)
def _symbol(c: str) -> str:
    return symbols(c)


def bigrams(text: str) -> set[tuple[str, str]]:
    """The distinct bigrams of a text without lost characters, line ends standing before and after it."""
    s = symbols(text)
    found = set(zip("\n" + s, s + "\n"))
    return found if "\ufffd" not in s else {x for x in found if "\ufffd" not in x}


@lru_cache(maxsize=100_000)
def _units_of(run: str) -> tuple[tuple[tuple[int, str, tuple[Unit, ...], int], ...], tuple[tuple[int, list[Unit]], ...]]:
    """What no model changes: (state, text restored, units, characters that are no units) of the pairs of one-byte encodings that
    have units in a run, and (state, units) of the others."""
    ones, others = [], []
    for s, pair in enumerate(_pairs()):
        if pair.form == "one":
            # every character that the pair has is a unit
            made = "".join([pair.map.get(c, c) for c in run])
            units = tuple([(i, i + 1, b) for i, (a, b) in enumerate(zip(run, made)) if a != b])
            if units:
                ones.append((s, made, units, sum([c >= "\x80" and c not in pair.same for c in run]) - len(units)))
        elif (units := pair.units(run)) or s in STRIPPED:
            others.append((s, units))
    return tuple(ones), tuple(others)


class Model:
    """Bigram tables by language, "" being that of all, and the labelling by them.

    counts: number of texts by (language, first, second); first is empty for the number of texts of a language.
    """

    def __init__(self, counts: dict[tuple[str, str, str], float]):
        tables: dict[str, Counter] = defaultdict(Counter)
        for (lang, p, c), n in counts.items():
            for at in {"", lang}:
                tables[at][p, c] += n
        for lang, text in SEED.items():
            for at in ("", lang):
                for x in bigrams(text):
                    tables[at][x] += SEED_WEIGHT
        self.tables, self.sums, self.types = {}, {}, {}
        for lang, table in tables.items():
            less = SHARE * table.pop(("", ""), 0)
            self.tables[lang] = kept = {x: n - less for x, n in table.items() if n > less}
            self.sums[lang], self.types[lang] = Counter(), Counter()
            for (p, _), n in kept.items():
                self.sums[lang][p] += n
                self.types[lang][p] += 1
        self.by_kind, self.of_kind, self.kinds, self.chars, self.per_kind = Counter(), Counter(), Counter(), Counter(), Counter()
        for (p, c), n in self.tables[""].items():
            k, kc = kind(p), kind(c)
            self.by_kind[k, c] += n
            self.of_kind[k] += n
            self.kinds[k, kc] += n
            self.chars[c] += n
            self.per_kind[kc] += n
        self.kind_types = Counter(k for k, _ in self.by_kind)
        #: Characters that a lost one may have been.
        self.known = tuple(sorted({"\xa0", *(c for c in self.chars if "\xa0" <= c < "\ue000")}))
        self._ready()

    def _ready(self) -> None:
        self.cost = lru_cache(maxsize=400_000)(self._cost)
        self.run = lru_cache(maxsize=200_000)(self._run)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cost", "run")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _cost(self, lang: str, p: str, c: str) -> float:
        """Negative logarithm of the probability of symbol c after symbol p: the language's share, backed by all, by kinds, by size."""
        k, kc = kind(p), kind(c)
        within = (self.chars[c] + 0.5) / (self.per_kind[kc] + 0.5 * _SIZES[kc])
        if c >= "\ue000":
            within /= _SIZES[kc]  # one of the characters that this symbol stands for
        of_kind = (self.kinds[k, kc] + 0.02 + (k == kc)) / (self.of_kind[k] + 3.0)
        types = self.kind_types[k] + 1
        every = (self.by_kind[k, c] + types * of_kind * within) / (self.of_kind[k] + types)
        for at in ("", lang) if lang in self.tables and lang else ("",):
            types = self.types[at][p] + 1
            every = (self.tables[at].get((p, c), 0.0) + types * every) / (self.sums[at][p] + types)
        if (p.isupper() or c.isupper()) and not p.islower() and len(p.lower() + c.lower()) == 2 and (p.lower(), c.lower()) != (p, c):
            # in capitals, what is usual in small letters is nearly as usual; one at the start of a word is less so
            every = max(every, CAPITALS ** (1 if p.isupper() else 3) * math.exp(-self.cost(lang, p.lower(), c.lower())))
        return -math.log(every)

    def step(self, lang: str, p: str, c: str) -> float:
        return self.cost(lang, _symbol(p), _symbol(c))

    def of_text(self, lang: str, before: str, text: str, after: str) -> float:
        whole = [_symbol(c) for c in (before, *text, after)]
        return sum(self.cost(lang, p, c) for p, c in zip(whole, whole[1:]))

    def _run(self, lang: str, before: str, run: str, after: str) -> tuple[float, dict[int, tuple[float, tuple[Unit, ...]]]]:
        """(cost of the run as it stands, {state: (cost, units)} of the states that have units in it)."""
        clean = self.of_text(lang, before, run, after)
        states: dict[int, tuple[float, tuple[Unit, ...]]] = {}
        every: set[Unit] = set()
        ones, others = _units_of(run)
        for s, made, own_units, own in ones:
            states[s] = (self.of_text(lang, before, made, after) + UNIT * len(own_units) + MIXED * own, own_units)
        for s, units in others:
            every.update(units)
            if s in STRIPPED:
                units = units + _pairs()[s].torn(run, units, self.known)
            if units:
                states[s] = self._path(lang, before, run, after, units)
        if "�" in run:
            lost = [(i, i + 1, TORN + c) for i, x in enumerate(run) if x == "\ufffd" for c in self.known]
            states[LOST] = self._path(lang, before, run, after, lost)
        if every or clean > ENTER_SHOWN:
            # a unit, or a single character among ASCII ones, that has no letters at its sides
            every.update((i, i + 1, "") for i, c in enumerate(run) if c >= "\x80" and (i == 0 or run[i - 1] < "\x80") and run[i + 1 : i + 2] < "\x80")
            sides = {(a, b): (run[a - 1 : a] or before, run[b : b + 1] or after, c == "") for a, b, c in every}
            shown = [(a, b, '"' if x in QUOTES or y in QUOTES else "." if alone else " ") for (a, b), (x, y, alone) in sides.items() if _apart(x) and _apart(y)]
            if shown:
                states[SHOWN] = self._path(lang, before, run, after, shown, True)
        return clean, {s: x for s, x in states.items() if x[1] and x[0] < clean + 20}

    def _path(self, lang: str, before: str, run: str, after: str, units: list[Unit], shown: bool = False) -> tuple[float, tuple[Unit, ...]]:
        """The cheapest way through a run within one state: its units, and clean characters at a price where they are not ASCII."""
        at: dict[int, list[Unit]] = {}
        for u in units:
            at.setdefault(u[0], []).append(u)
        best: list[dict[str, tuple[float, tuple | None]]] = [{} for _ in range(len(run) + 1)]
        # last restored character and whether the path is amid clean ones
        best[0][before, False] = (0.0, None)
        for i, c in enumerate(run):
            here = best[i]
            if len(here) > 2 * WIDTH:
                here = dict(sorted(here.items(), key=lambda x: x[1][0])[:WIDTH])
            for (last, amid), (cost, back) in here.items():
                plain = c < "\x80"
                key, x = (c, amid if plain else not shown), cost + (self.step(lang, last, c) if last else 0.0) + (0.0 if plain or amid or shown else MIXED)
                if key not in best[i + 1] or x < best[i + 1][key][0]:
                    best[i + 1][key] = (x, back)
                for u in at.get(i, ()):
                    if shown:
                        key, x = ("", False), cost + (QUOTED if u[2] == '"' else MARK if c == "\ufffd" else SINGLE if u[2] == "." else APART)
                    elif u[2][0] == TORN:
                        # of a blank that does not break a plain one was made, which follows
                        blank = u[2][1] == "\xa0"
                        key, x = ("" if blank else u[2][1], False), cost + (REMAINS if c != "\ufffd" else UNIT) + self.step(lang, last or " ", " " if blank else u[2][1])
                    else:
                        key, x = (u[2][-1], False), cost + UNIT + sum(self.step(lang, p, q) for p, q in zip((last or " ") + u[2], u[2]))
                    if key not in best[u[1]] or x < best[u[1]][key][0]:
                        best[u[1]][key] = (x, (u, back))
        ends = [(cost + (self.step(lang, last, after) if last else 0.0), back) for (last, _), (cost, back) in best[len(run)].items()]
        cost, back = min(ends, key=lambda x: x[0])
        found = []
        while back is not None:
            u, back = back
            found.append(u)
        return cost, tuple(found[::-1])

    def label(self, text: str, lang: str = "") -> list[tuple[int, int, int, str | None]]:
        """The units of the cheapest path that are neither clean nor only shown: (start, end, state, original or None)."""
        clean_state = -1
        best: dict[int, tuple[float, tuple | None]] = {clean_state: (0.0, None)}
        for m in _patterns()[0].finditer(text):
            a, b = m.span()
            clean, states = self.run(lang, _before(text, a), m[0], text[b : b + 1] or "\n")
            # entering a state pays only where it gains something
            if len(best) == 1 and all(x[0] >= clean for x in states.values()):
                continue
            low_state = min(best, key=lambda s: best[s][0])
            low = best[low_state][0] + (LEAVE if low_state != clean_state else 0.0)
            stay = min(best[clean_state], (low, best[low_state][1]), key=lambda x: x[0])
            moved: dict[int, tuple[float, tuple | None]] = {clean_state: (stay[0] + clean, stay[1])}
            for s in {*best, *states} - {clean_state}:
                entered = (low + _enter(s), best[low_state][1])
                cost, back = min(best[s], entered, key=lambda x: x[0]) if s in best else entered
                if s in states:
                    moved[s] = (cost + states[s][0], (a, s, states[s][1], back))
                elif s in best:
                    moved[s] = (cost + clean + (0.0 if s == SHOWN or s < LOST and _pairs()[s].keeps(m[0]) else MIXED), back)
            # a state that costs more than to enter it anew is of no use
            best = {s: x for s, x in moved.items() if s == clean_state or x[0] < moved[clean_state][0] + _enter(s)}
        back = min(best.values(), key=lambda x: x[0])[1]
        found = []
        while back is not None:
            at, s, units, back = back
            if s != SHOWN:
                found += [(at + a, at + b, s, None if c[0] == TORN else c) for a, b, c in reversed(units)]
        return found[::-1]

    def _sound(self, text: str, found: list[tuple[int, int, int, str | None]]) -> dict[int, bool]:
        """Whether the units of each state restore writing that is likely in some language."""
        price: dict[int, list[float]] = defaultdict(list)
        last, upto = "", -1
        for a, b, s, c in found:
            if c is not None:
                price[s].append(sum(self.step("", p, q) for p, q in zip((last if a == upto else _before(text, a)) + c, c)) / len(c))
                last, upto = c[-1], b
        return {s: sum(x) <= PLAUSIBLE * len(x) for s, x in price.items()}

    def restore(self, text: str | None, lang: str | None = None) -> tuple[bool, str | None]:
        """(garbled, original): original is the text itself if it isn't garbled, None if it cannot be recovered in full."""
        lang = (lang or "").strip().lower()
        if not text or text.isascii():
            return False, text
        now, certain = text, False
        for layer in range(LAYERS + 1):
            found = self.label(now, lang)
            sound = self._sound(now, found)
            # units that restore nothing likely are there by chance
            found = [u for u in found if sound.get(u[2], True)]
            if not found:
                return layer > 0, now
            if layer == 0:
                certain = any(u[2] == LOST or _pairs()[u[2]].right == "utf-8" for u in found)
            if layer == LAYERS or any(u[3] is None for u in found):
                return (True, None) if certain else (False, text)
            made, pos = [], 0
            for a, b, _, c in found:
                made += (now[pos:a], c)
                pos = b
            now = "".join(made) + now[pos:]
        raise AssertionError


def _apart(side: str) -> bool:
    return side in QUOTES or side.isascii() and not side.isalnum()


def _enter(state: int) -> float:
    return ENTER_LOST if state == LOST else ENTER_SHOWN if state == SHOWN else _pairs()[state].enter


def _before(text: str, at: int) -> str:
    """The symbol before a place of a text."""
    c = text[at - 1 : at] if at else "\n"
    return AFTER_DIGIT if c == " " and text[at - 2 : at - 1].isdigit() else c


def _counted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(lang, first, second, n) for batches (text, lang): the number of texts, clean ones by the model, of each bigram;
    first is empty for the number of all these texts."""
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
            if text and not model.restore(text, lang)[0]:
                counts[lang].update(bigrams(text))
                counts[lang]["", ""] += 1
        rows = [(lang, p, c, n) for lang, table in counts.items() for (p, c), n in table.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "first", "second", "n"])


def fit(documents: DataFrame, text_col: str = "text", lang_col: str | None = "lang", sample: int | None = None) -> Model:
    """The model of a table: bigrams of all its rows, at the rate of their number in ``RATE`` rows, so that the prior weighs the
    same in a table of any size. With ``sample``, of about so many rows, drawn by the hash of their texts.

    What comes to the driver is a table of distinct bigrams, at most the square of the 1,800 symbols per language, whatever the
    number or the length of the texts. The prior's model chooses the rows that count, then the model of these does.
    """
    total = documents.count()
    lang = F.lower(F.trim(F.coalesce(F.col(lang_col), F.lit("")))) if lang_col and lang_col in documents.columns else F.lit("")
    rows = documents.select(F.col(text_col).alias("text"), F.when(lang.rlike("^[a-z]{2,3}$"), lang).otherwise("").alias("lang")).filter("text is not null")
    if sample and total > sample:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < int(sample / total * (1 << 31)))
        total = sample
    rate = min(1.0, RATE / max(total, 1))
    model = Model({})
    for _ in range(ROUNDS):
        counted = rows.mapInArrow(lambda batches, m=model: _counted(batches, m), "lang string, first string, second string, n long").groupBy("lang", "first", "second").agg(F.sum("n").alias("n"))
        model = Model({(r.lang, r.first, r.second): r.n * rate for r in counted.collect()})
    return model


def find_garbled(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", model: Model | None = None) -> DataFrame:
    """One row (id_col, restored_text, restored_md5) per garbled text; restored_text is null and restored_md5 empty where the
    original cannot be recovered in full.

    Null and empty texts are no cases. Repeated texts and ids count each; a missing or null language takes the table of all.
    Other columns are not read. Without a model one is fitted (two small jobs). The work is one pass over the texts without a
    shuffle; a text is held whole, so one task needs memory for its longest text.
    """
    model = model or fit(documents, text_col, lang_col)
    id_type = documents.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col) if lang_col and lang_col in documents.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, sums = [], [], []
            for i, (text, lang) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                garbled, original = model.restore(text, lang)
                if garbled:
                    rows.append(i)
                    texts.append(original)
                    sums.append("" if original is None else hashlib.md5(original.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(sums, pa.string())], names=[id_col, "restored_text", "restored_md5"])

    # a text of ASCII only has the clean path; this test stays in the JVM and spares Python these rows
    kept = documents.select(F.col(id_col), F.col(text_col).alias("text"), lang.alias("lang")).filter(F.col("text").rlike(_NON))
    return kept.mapInArrow(run, f"`{id_col}` {id_type}, restored_text string, restored_md5 string")
