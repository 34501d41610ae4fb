"""Broken question-answer pairs: empty, copied, other_language, refusal, truncated.

One pass over the pairs (Arrow batches) takes the answer out of its wrapping, makes the checks that need one pair only
(empty, copied, language) and masks names and numbers.  The rest is decided by what recurs over all pairs:

* Refusals: the masked openings of all answers are clustered by MinHash on their character trigrams; openings that share a
  band meet in rounds of leaders, links are verified by Jaccard similarity and joined to connected components.  A template
  that recurs across prompts of unrelated kinds says nothing about any of them: it is a refusal.  Right answers, and wrong
  ones that belong to another question, are at home with one kind of prompt.
* Truncated answers: a last sentence without a stop is compared with all sentences. If it goes on in many others and hardly
  ever ends there, it breaks off; if others end there with a stop, only the stop is missing.
* Other languages: words are judged by character trigrams per language, fitted on all labelled texts and pairs; an answer
  counts if it is likelier in another language than the question's by a margin. Where the answers to one form of question often are in
  another language ("What is the title of ..."), the form asks for that.

Statistics are sums over all distinct pairs of prompt and answer, so copies move none, made of distinct masks, and join back
by value. Nothing is collected but the trigram table, whose size is bounded.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.garbled import SEED
from lodestone.session import checkpointed

#: Words of an opening, characters of a shingle, similarity of a link, MinHash functions and rows of a band.
OPENING, SHINGLE, SIMILAR, HASHES, BAND = 10, 3, 0.8, 64, 4
#: A template is a refusal if it recurs over so many kinds of prompts and prompts, and no kind has more than this share; for a
#: kind that many prompts have, the rest counts in proportion to the other prompts.
KINDS, PROMPTS, SHARE = 3, 4, 0.6
#: A sentence that goes on in others breaks off if fewer than this share of them end there.
ENDS = 0.02
#: Sentences of up to so many masked words and signs are judged as wholes only.
SHORT = 7
#: Rows of a batch of prefixes, and the modulus and factor of the rolling hash of a prefix.
ROWS, MODULUS, FACTOR = 50_000, (1 << 61) - 1, 1_000_003

#: Answers that say that there is none.
NOTHING = frozenset("null none nil nan na n/a undefined empty blank void tbd todo answer réponse antwort respuesta resposta".split())

#: Buckets of trigrams of the language model, weight of the prior's texts against so many rows of a larger table, the share of all
#: languages in each, and how often the pairs are labelled and counted; in place of a bucket, the number of texts.
BUCKETS, PRIOR, RATE, SMOOTH, FITS, TEXTS = 1 << 16, 3, 10_000, 0.1, 3, -1
#: An answer is in another language if that is likelier by this much (natural logarithm; twice as much for one word), and by this
#: much a word; languages of a question so close to its likeliest are its own, too.
MARGIN, A_WORD, TIED = 3.0, 0.8, 3.0
#: A form of question asks for another language if so many pairs, and this share of them, have one.
FORM, FORM_SHARE = 3, 1 / 3

#: Words that call for a following one.
DANGLING = {
    "en": frozenset("the a an of to and with by from that which who for as because but or if than then at into whose such while although our my your his her their was were is are".split()),
    "fr": frozenset("le la les un une des du de et avec pour par sur qui que dont parce mais ou puis dans chez leur cette ce tandis alors était sont est".split()),
    "de": frozenset("der das den dem des ein eine einen einem einer und mit für von zum zur bei im weil wenn dass oder dann nach während sowie die".split()),
    "es": frozenset("el la los las un de del y con por para en que porque pero o luego su sus una cuyo donde mientras al era es".split()),
}
#: Plain sentences with the small words of a language, the prior's second text of each.
PLAIN = {
    "en": "This is what we know about it: he was there with them before she came, and they have been here since then. It may be under the table, behind the house or near the bridge, but I do not think that you would find any of those things outside of our town. When did they go, where were you, why is it so, how much of this can be said, and who has told you which of them will not talk to us?",
    "fr": "C’est ce que nous savons de lui : il était là avec eux avant qu’elle ne vienne, et ils sont ici depuis. Il est peut-être sous la table, derrière la maison ou près du pont, mais je ne crois pas que vous trouviez rien de tout cela hors de notre ville. Quand sont-ils partis, où étiez-vous, pourquoi est-ce ainsi, combien peut-on en dire, et qui vous a dit lequel ne veut plus nous parler ?",
    "de": "Das ist alles, was wir über ihn wissen: er war dort mit ihnen, bevor sie kam, und seitdem sind sie hier. Vielleicht liegt es unter dem Tisch, hinter dem Haus oder bei der Brücke, aber ich glaube nicht, dass ihr etwas davon außerhalb unserer Stadt findet. Wann sind sie gegangen, wo wart ihr, warum ist das so, wie viel kann man davon sagen, und wer hat euch gesagt, welcher von ihnen nicht mehr mit uns reden will?",
    "es": "Esto es lo que sabemos de él: estaba allí con ellos antes de que ella viniera, y desde entonces están aquí. Quizá esté debajo de la mesa, detrás de la casa o cerca del puente, pero no creo que encuentren nada de eso fuera de nuestra ciudad. ¿Cuándo se fueron, dónde estaban ustedes, por qué es así, cuánto se puede decir, y quién les ha dicho cuál de ellos ya no quiere hablar con nosotros?",
    "pt": "Isto é o que sabemos dele: estava ali com eles antes que ela viesse, e desde então estão aqui. Talvez esteja debaixo da mesa, atrás da casa ou perto da ponte, mas não acho que vocês encontrem nada disso fora da nossa cidade. Quando foram embora, onde vocês estavam, por que é assim, quanto se pode dizer, e quem lhes disse qual deles já não quer falar conosco?",
    "it": "Questo è quello che sappiamo di lui: era lì con loro prima che lei venisse, e da allora sono qui. Forse è sotto il tavolo, dietro la casa o vicino al ponte, ma non credo che troviate niente di tutto questo fuori dalla nostra città. Quando sono andati via, dove eravate, perché è così, quanto se ne può dire, e chi vi ha detto quale di loro non vuole più parlare con noi?",
    "pl": "Oto co o nim wiemy: był tam z nimi, zanim ona przyszła, i od tego czasu są tutaj. Może jest pod stołem, za domem albo niedaleko mostu, ale nie sądzę, żebyście znaleźli coś z tego poza naszym miastem. Kiedy odeszli, gdzie byliście, dlaczego tak jest, ile można o tym powiedzieć i kto wam powiedział, który z nich już nie chce z nami rozmawiać?",
    "cs": "To je to, co o něm víme: byl tam s nimi, než ona přišla, a od té doby jsou tady. Možná je pod stolem, za domem nebo blízko mostu, ale nemyslím, že něco z toho najdete mimo naše město. Kdy odešli, kde jste byli, proč je to tak, kolik se o tom dá říct a kdo vám řekl, který z nich už s námi nechce mluvit?",
}
_DANGLES = frozenset().union(*DANGLING.values())
#: First letters of the names of languages in questions.
NAMED = {
    "en": ("english", "anglais", "englisch", "inglés", "inglês"), "fr": ("french", "français", "französisch", "francés", "francês"), "de": ("german", "allemand", "deutsch", "alemán", "alemão"),
    "es": ("spanish", "espagnol", "spanisch", "español", "espanhol"), "pt": ("portuguese", "portugais", "portugiesisch", "portugués", "português"), "ru": ("russian", "russe", "russisch", "ruso"),
    "ja": ("japanese", "japonais", "japanisch", "japonés"), "it": ("italian", "italien", "italiano"), "zh": ("chinese", "chinois", "chinesisch", "chino"), "ar": ("arabic", "arabe", "arabisch", "árabe"),
}
_NAMED = re.compile("|".join(n for names in NAMED.values() for n in names))

#: How an answer begins that declines by itself, whatever the prompt.
DECLINES = regex.compile(
    r"(?:(?:(?:i\s+am|i'm)\s+(?:(?:so|very|really)\s+)?(?:sorry|afraid)|sorry|apologies|unfortunately)\b[\s,.:!—–-]*(?:but\s+|that\s+)?)?"
    r"i\s+(?:(?:can\s?not|can't|won't|will\s+not|could\s+not|couldn't)\s+(?:answer|help|assist|comment|say|tell|discuss|provide|share|disclose|do\s+that)|(?:must|have\s+to|would\s+rather|will)\s+(?:decline|refuse|not\s+answer)|decline|refuse|am\s+(?:unable|not\s+able|not\s+allowed)\s+to\s+(?:answer|help|say|tell|provide|share))\b"
    r"|(?:désolée?[\s,.:!]*(?:mais\s+)?)?je\s+(?:refuse|décline|(?:ne\s+peux|ne\s+puis|ne\s+souhaite)\s+pas\s+(?:vous\s+)?(?:y\s+)?(?:répondre|aider|le\s+dire))\b"
    r"|(?:(?:tut\s+mir\s+leid|leider)[\s,.:!]*(?:aber\s+)?)?(?:ich\s+(?:lehne|verweigere)\b|(?:ich\s+(?:kann|darf|möchte)|(?:kann|darf)\s+ich)\s+(?:das|dies|diese\s+frage|darauf|dazu|ihnen|dir)?\s*(?:leider\s+)?nicht[s]?\s+(?:beantworten|antworten|sagen|helfen))"
    r"|(?:lo\s+siento[\s,.:!]*(?:pero\s+)?)?(?:no\s+(?:puedo|quiero)\s+(?:responder|contestar|ayudar|decir)|me\s+niego|prefiero\s+no\s+(?:responder|contestar))"
    r"|(?:申し訳(?:ありません|ございません)|すみません)?[がけど、。]*(?:お答え|回答|答えることは?)(?:する|いたし|は|を)?(?:でき(?:ません|ない|かね)|できません|控え|差し控え)"
    r"|(?:抱歉|对不起)?[，,。]*我?(?:无法|不能|拒绝)回答|(?:извините[\s,.]*(?:но\s+)?)?я\s+не\s+(?:могу|буду)\s+(?:на\s+это\s+)?(?:ответить|отвечать|помочь)"
)
#: Questions after spoken or written words, which may be a refusal themselves.
SPEECH = regex.compile(r"\b(?:sa(?:y|id|ys)|repl|answer|respon|répon|tell|told|wr[io]te|word|quot|message|letter say|dit\b|dire|dis(?:e|ent)|sag(?:t|en|te)|antwort|erwider|schr[ei]|dij|dec[ií]|dice|contest|escrib|mot\b|palabra)|言|答|сказа|ответ|说")

_SCRIPTS = {"ja": regex.compile(r"[\p{Hiragana}\p{Katakana}]"), "zh": regex.compile(r"\p{Han}"), "ru": regex.compile(r"\p{Cyrillic}"), "ar": regex.compile(r"\p{Arabic}"), "he": regex.compile(r"\p{Hebrew}"), "ko": regex.compile(r"\p{Hangul}"), "el": regex.compile(r"\p{Greek}"), "hi": regex.compile(r"\p{Devanagari}")}
_BEYOND = regex.compile(r"[^\u0000-\u036f\u1e00-\u22ff]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*")
_ASCII_TOKEN = re.compile(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*|[^ \t\n\r\f\vA-Za-z0-9]")
#: _WORD for texts without the characters of _FAR, where it finds the same in less time.
_FAR, _NEAR_WORD = re.compile("[^\\u0000-\\u02ff\\u2000-\\u206f€]"), re.compile(r"[^\W_]+(?:['’][^\W\d_²³¹¼½¾]+)*")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*|[^\s\p{L}\p{M}\p{N}]")
#: The same for _TOKEN; only the newer engine takes the last four for signs.
_NEAR_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[^\s\w]|[_\x1c-\x1f]")
_SENTENCE = regex.compile(r"(?<=[.!?。！？][\"”»’)\]]{0,2})\s+|(?<=[。！？])|\n+")
#: What a text has where _SENTENCE may divide it.
_DIVIDED = re.compile(r"[.!?][\"”»’)\]]{0,2}\s|[。！？\n]")
_STOP = regex.compile(r"[.!?。！？][\"'”»’)\]」』*_]*$|[)\]}\"”»」』]$")
_ELLIPSIS = regex.compile(r"(?:…|\.{2,})\s*$")
_ITEM, _END = regex.compile(r"^\s*(?:[-*•]|\d+[.)])\s+"), regex.compile(r"[\s.!?。！？\"'”»’)\]」』]+$")
_BARE_ITEM, _OPENS = regex.compile(r"(?:^|\n)\s*(?:\d+[.)]|[-*•])\s*$"), regex.compile(r"[,;:(\[{–„“«¿¡&/-]\s*(?:…|\.\.\.)?$")
_TAGGED, _CLOSED = regex.compile(r"(?i)<answer>|\\boxed\{"), regex.compile(r"(?i)</answer>|\\boxed\{[^}]*\}")
_QUOTES, _QUOTED = re.compile("[“«„\"]"), regex.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"]*\"")


@lru_cache(maxsize=1024)
def _words(text: str) -> list[str]:
    return (_NEAR_WORD if text.isascii() or not _FAR.search(text) else _WORD).findall(text)


@lru_cache(maxsize=1024)
def _lower_words(text: str) -> list[str]:
    """The words of a text in lower case."""
    # a sigma's small letter depends on what is around its word
    return _words(text.lower()) if "Σ" in text else [w.lower() for w in _words(text)]


def _bucket(trigram: str) -> int:
    return zlib.crc32(trigram.encode("utf-8", "surrogatepass")) % BUCKETS


@lru_cache(maxsize=100_000)
def _trigrams(word: str) -> tuple[int, ...]:
    w = f"^{word}$"
    return tuple(_bucket(w[i : i + 3]) for i in range(len(w) - 2)) or (_bucket(w),)


def small_words(text: str, first: bool = True) -> list[str]:
    """The words of a text that begin with a small letter, and the signs of some languages ("¿"); its first word, where it is
    wanted, counts in any letters."""
    words = _words(text.replace("’", "'"))
    made = [w.lower() for w in words if w[0].islower()]
    if first and words and words[0][0].isalpha() and not words[0][0].islower():
        made.insert(0, words[0].lower())
    return made if text.isascii() else made + [c for c in "¿¡" if c in text]


class Languages:
    """Character trigrams of words by language: counts of (language, bucket), the prior's texts included."""

    def __init__(self, counts: dict[tuple[str, int], float]):
        self.names = tuple(sorted(PLAIN))
        tables = {x: Counter() for x in self.names}
        for (lang, bucket), n in counts.items():
            tables[lang][bucket] += n
        for lang in self.names:
            for w in small_words(f"{SEED[lang]} {PLAIN[lang]}".lower()):
                for b in _trigrams(w):
                    tables[lang][b] += PRIOR
        shares: Counter = Counter()
        for table in tables.values():
            total = sum(table.values())
            for b, n in table.items():
                shares[b] += n / total / len(tables)
        # likelihood against the mean of the languages; a bucket that none has tells nothing
        totals = [sum(t.values()) for t in tables.values()]
        self.table = {b: tuple(math.log((1 - SMOOTH) * t[b] / n / share + SMOOTH) for t, n in zip(tables.values(), totals)) for b, share in shares.items()}
        self._ready()

    def _ready(self) -> None:
        self.of_word = lru_cache(maxsize=200_000)(self._of_word)
        self.of_words = lru_cache(maxsize=20_000)(self._of_words)
        self.of_question = lru_cache(maxsize=4096)(self._of_question)

    def __getstate__(self) -> dict:
        return {"names": self.names, "table": self.table}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _of_word(self, word: str) -> tuple[float, ...]:
        known = [x for b in _trigrams(word) if (x := self.table.get(b))]
        return tuple(map(sum, zip(*known))) if known else (0.0,) * len(self.names)

    def scores(self, words: Iterable[str]) -> tuple[float, ...]:
        """Evidence for each language (of names): each different word counts once."""
        return self.of_words(frozenset(words))

    def _of_words(self, words: frozenset[str]) -> tuple[float, ...]:
        found = [self.of_word(w) for w in sorted(words)]
        return tuple(map(sum, zip(*found))) if found else (0.0,) * len(self.names)

    def _of_question(self, question: str) -> tuple[frozenset[str], frozenset[str], str | None, tuple[float, ...]]:
        """(words, languages that it names, script, evidence) of a question."""
        asked = question.lower()
        wanted = frozenset(lang for lang, names in NAMED.items() if any(n in asked for n in names)) if _NAMED.search(asked) else frozenset()
        return frozenset(_lower_words(question.replace("’", "'"))), wanted, _script(question), self.scores(small_words(question))

    def best(self, text: str) -> str | None:
        """The likeliest language of a text; null without evidence."""
        return self.best_of(small_words(text))

    def best_of(self, words: Iterable[str]) -> str | None:
        scores = self.scores(words)
        return self.names[max(range(len(scores)), key=scores.__getitem__)] if any(scores) else None


_COUNT = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
_FORM = pa.schema([("asked", pa.string()), ("said", pa.string()), ("n", pa.int64())])


def _summed(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) for counts of buckets by language."""
    rows = [(lang, b, n) for lang, table in counts.items() for b, n in table.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _COUNT)], schema=_COUNT)


def _spread(words: dict[str, Counter], counts: dict[str, Counter]) -> None:
    """Adds the buckets of counted words by language to counts."""
    for lang, table in words.items():
        here = counts[lang]
        for w, n in table.items():
            for b in _trigrams(w):
                here[b] += n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) for batches (text, lang), and ("", TEXTS, number of texts); a task holds at most BUCKETS counts a language."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        counts[""][TEXTS] += batch.num_rows
        words: dict[str, Counter] = defaultdict(Counter)
        every: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
            every[lang].update(text.split())
            # what small_words finds besides small words
            w = _WORD.search(text)
            if w and text[w.start()].isalpha() and not text[w.start()].islower():
                words[lang][w[0].lower().replace("’", "'")] += 1
            if not text.isascii():
                words[lang].update([c for c in "¿¡" if c in text])
        # no word goes over white space, so each different run between is divided once
        for lang, table in every.items():
            for run, n in table.items():
                for w in _words(run.replace("’", "'")):
                    if w[0].islower():
                        words[lang][w.lower()] += n
        _spread(words, counts)
    yield from _summed(counts)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(small words of the question, of the answer, n) for batches (question, answer)."""
    of = lru_cache(maxsize=20_000)(lambda text, first: " ".join(small_words(text, first)))
    for batch in batches:
        pairs = Counter(zip(*(c.to_pylist() for c in batch.columns)))
        forms: Counter = Counter()
        for (question, answer), n in pairs.items():
            forms[of(question, True), of(answer, False)] += n
        if forms:
            asked, said = zip(*forms)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((asked, said, forms.values()), _FORM)], schema=_FORM)


def _labelled(batches: Iterator[pa.RecordBatch], languages: Languages) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) for batches of _forms, by the pair's likeliest language."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for asked, said, n in zip(*(c.to_pylist() for c in batch.columns)):
            # an answer counts only if it is in the pair's language by itself
            own, every = said.split(), asked.split() + said.split()
            lang = languages.best_of(every)
            if lang and lang == languages.best_of(own):
                table = words[lang]
                for w in every:
                    table[w] += n
        _spread(words, counts)
    yield from _summed(counts)


def fit_languages(pairs: DataFrame, labelled: DataFrame | None = None) -> Languages:
    """The languages of (question, answer) rows: the prior's and those of a table (text, lang) label the pairs, whose words are
    counted then.

    All rows of both tables count, at the rate of their number in ``RATE`` rows: else the few pairs that are put down to a
    language without texts of its own would outweigh its prior as soon as a table is large. Pairs of the same small words
    (names and numbers are none) are labelled once and count as often as they occur; at most BUCKETS counts a language come to
    the driver, whatever the number or the length of the texts.
    """
    collect = lambda rows, count: {(r.lang, r.bucket): r.n for r in rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()}
    rated = lambda counts, rows: {x: n * min(1.0, RATE / max(rows, 1)) for x, n in counts.items()}
    known: dict[tuple[str, int], float] = {}
    if labelled is not None:
        found = collect(labelled.select("text", F.lower(F.trim("lang")).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isin(*PLAIN)), _counted)
        known = rated(found, found.pop(("", TEXTS), 0))
    languages = Languages(known)
    forms = checkpointed(pairs.dropna().mapInArrow(_forms, "asked string, said string, n long").groupBy("asked", "said").agg(F.sum("n").alias("n")))
    rows = forms.agg(F.sum("n").alias("n")).first().n or 0
    for _ in range(FITS):
        counts = Counter(known)
        counts.update(rated(collect(forms, lambda batches, model=languages: _labelled(batches, model)), rows))
        languages = Languages(counts)
    return languages


def _script(text: str) -> str | None:
    if text.isascii() or _BEYOND.search(text) is None:
        return None
    letters = sum(c.isalpha() for c in text)
    for lang, pattern in _SCRIPTS.items():
        if letters and 2 * len(pattern.findall(text)) > letters:
            return lang
    return None


#: Patterns, what stands for them, and signs of which a text has to have one for the pattern to match.
_WRAPS = tuple(
    (regex.compile(a), b, signs)
    for a, b, signs in (
        (r"(?is)<think>.*?</think>", " ", "<"),
        (r"(?i)</?(?:answer|response|output|final|result)\s*/?>", " ", "<"),
        (r"```[a-z]*|\\boxed\{|\\text\{|`", " ", "`\\"),
        (r"(?i)^[\s*_#>\"'“-]*(?:final\s+answer|answer|antwort|réponse|respuesta|resposta|a)\s*(?:[*_]+\s*)?:[\s*_]*", "", ":"),
    )
)


@lru_cache(maxsize=256)
def unwrap(answer: str) -> str:
    """An answer without tags, fences, boxes, emphasis and lead-ins such as "Answer:"."""
    x = answer
    for pattern, by, signs in _WRAPS:
        if any([c in x for c in signs]):
            x = pattern.sub(by, x)
    return x.strip(" \t\r\n \u200b\ufeff*_#{}")


def is_empty(answer: str | None) -> bool:
    """Null, or nothing in it that could be an answer."""
    if answer is None:
        return True
    core = unwrap(answer)
    return not core[:1].isalnum() and _WORD.search(core) is None or core.lower().strip(" .:!?\"'()[]<>*-—_") in NOTHING


@lru_cache(maxsize=4096)
def _grams(q: str) -> tuple[list[str], frozenset[str]]:
    """The bigrams of a text in order, and its trigrams."""
    return [q[i : i + 2] for i in range(len(q) - 1)], frozenset([q[i : i + 3] for i in range(len(q) - 2)])


def _may_be_dense(q: str, a: str) -> bool:
    """Whether runs of a question may make up the dense end of an answer that is_copied asks for: only necessary, but cheap."""
    # it reaches back no further, and has 0.75 of the question's characters, each in one of its bigrams
    end = a[-int(len(q) / 0.85) - 4 :]
    has = [b in end for b in _grams(q)[0]]
    return sum([x or y for x, y in zip([False, *has], [*has, False])]) >= 0.75 * len(q)


@lru_cache(maxsize=200_000)
def _slip(f: str, w: str) -> bool:
    """Whether a word is the question's first one, perhaps with an ending or a slip of the pen."""
    if w == f or len(f) < 3 or w.startswith(f) or abs(len(w) - len(f)) > 1:
        return w == f or len(f) >= 3 and w.startswith(f)
    # the letters that both have bound the ratio
    return 2 * sum([min(f.count(c), w.count(c)) for c in {*f}]) > 0.74 * (len(f) + len(w)) and SequenceMatcher(None, f, w).ratio() > 0.74


def is_copied(question: str, answer: str) -> bool:
    """Only gives the question back: perhaps with a preface or slips of the pen, but with nothing after it and no new name or number."""
    core = unwrap(answer)
    asked, words = _lower_words(question), _lower_words(core)
    q, a = "".join(asked), "".join(words)
    if q and q in a and len(a.replace(q, "")) <= (2 if len(q) > 2 else 0):  # once or several times
        return True
    if len(q) < 8 or len(a) < 0.6 * len(q):  # too short to tell slips of the pen from other words
        return False
    # a run of two characters at least ends where two more at most follow; its first word and most of its trigrams must be there
    if a[-2:] not in q and a[-3:-1] not in q and a[-4:-2] not in q or not any([_slip(asked[0], w) for w in words]):
        return False
    grams = _grams(q)[1]
    if sum([g in a for g in grams]) < 0.6 * len(grams) or not _may_be_dense(q, a):
        return False
    blocks = SequenceMatcher(None, q, a, autojunk=False).get_matching_blocks()[:-1]
    blocks = [b for b in blocks if b.size >= 2]
    if not blocks:
        return False
    same, start, end = sum(b.size for b in blocks), blocks[0].b, blocks[-1].b + blocks[-1].size
    # a preface may hold letters of the question by chance: the copy starts where the dense part does
    for k in range(len(blocks)):
        rest = blocks[k:]
        size = sum(b.size for b in rest)
        if size >= 0.75 * len(q) and size >= 0.85 * (end - rest[0].b):
            same, start = size, rest[0].b
            break
    else:
        return False
    if len(a) - end > 2 or same < 0.75 * len(q):
        return False
    known = set(asked)
    pos = 0
    for i, w in enumerate(_words(core)):
        if pos + len(w) > start + 1:
            break
        if w.lower() not in known and (w[0].isdigit() or i and w[0].isupper() and w not in ("I", "Frage")):
            return False
        pos += len(w)
    return True


def other_language(question: str, answer: str, languages: Languages) -> bool:
    """The answer is plainly in another language than the question, which names no such language."""
    core = unwrap(answer)
    if _QUOTES.search(core):
        core = _QUOTED.sub(" ", core)
    known, wanted, own, home = languages.of_question(question)
    script = _script(core)
    if script:
        return script != own and script not in wanted
    if own:
        return len(_WORD.findall(core)) >= 3 and not wanted
    words = {w for w in small_words(core, False) if w not in known}
    if not any(home) or not words:
        return False
    scores = languages.scores(words)
    best = max(range(len(scores)), key=scores.__getitem__)
    # the question may be in any language that is not much less likely than its best
    least = max(home) - TIED
    own_scores = [x for h, x in zip(home, scores) if h >= least]
    return languages.names[best] not in wanted and scores[best] - max(own_scores) >= max(MARGIN if len(words) > 1 else 2 * MARGIN, A_WORD * len(words))


@lru_cache(maxsize=200_000)
def _masked(t: str) -> str:
    """A token in lower case; nothing for a number or a capitalised one."""
    return "" if t[0].isdigit() or (t[0].isupper() and not (t[0] == "I" and (len(t) == 1 or t[1] == "'"))) else t.lower()


def mask(text: str, names: frozenset[str] = frozenset()) -> list[str]:
    """Lower-case words and signs, with # for names (capital letters, and names of the question in any letters) and numbers, runs of # being one."""
    text = text.replace("’", "'")
    tokens = (_ASCII_TOKEN if text.isascii() else _TOKEN if _FAR.search(text) else _NEAR_TOKEN).findall(text)
    made = ["" if t in names else t for t in map(_masked, tokens)]
    return [t or "#" for t, before in zip(made, [None, *made]) if t or before not in ("", "#")] if "" in made else made


@lru_cache(maxsize=4096)
def kind_of_prompt(question: str) -> str:
    """The first two words of a question that are neither names nor numbers (its first word always counts)."""
    words = _words(question)
    return " ".join([w.lower() for w in words[:1]] + [w for w in words[1:] if not (w[0].isupper() or w[0].isdigit())][:1])[:40]


@lru_cache(maxsize=4096)
def names_in(question: str) -> frozenset[str]:
    """Names of a question in lower case; its first word doesn't count."""
    return frozenset(w.lower() for w in _words(question)[1:] if w[0].isupper() and len(w) > 2)


def declines(question: str, core: str) -> bool:
    """Whether an answer begins with declining in the first person, not quoted and not asked for: the check of openings that no template covers."""
    return DECLINES.match(core.lower().replace("’", "'").lstrip(" \t\r\n–—-")) is not None and SPEECH.search(question.lower()) is None


def openings_of(found: list[tuple[list[str], bool]]) -> tuple[list[str], list[str]]:
    """The opening, and that of the next sentence where the first is short ("Thanks for asking."). A first word is masked, as it may be a name."""
    first, *others = [["#", *tokens[1:]][:OPENING] for tokens, _ in found]
    return first, others[0] if others and len(found[0][0]) <= 6 else []


def sentences(core: str, names: frozenset[str] = frozenset()) -> list[tuple[list[str], bool]]:
    """Masked sentences without their stops, and whether they have one."""
    made = []
    for s in _SENTENCE.split(core) if _DIVIDED.search(core) else [core]:
        item = None if s[:1].isalpha() else _ITEM.match(s)
        s = (s[item.end() :] if item else s).strip()
        if not s:
            continue
        bare = _ELLIPSIS.sub("", s) if "…" in s or ".." in s else s
        # neither a stop nor what is left out at the end has a letter or digit
        stop = bare == s and not s[-1].isalnum() and _STOP.search(s) is not None
        tokens = mask(bare if bare[-1:].isalnum() else _END.sub("", bare), names)
        if tokens:
            made.append((tokens, stop))
    return made


def breaks_off(core: str, languages: Languages) -> bool:
    """Signs of a cut that one text shows by itself: it ends in a sign that opens or joins, or in an item without content."""
    words, end = _words(core), core.rstrip()[-1:]
    if end in ".)-*•" and _BARE_ITEM.search(core) and len(core) > 4 or not end.isalnum() and (end != "." or ".." in core) and _OPENS.search(core):
        return len(words) >= 3
    if len(words) >= 3 and words[-1] in _DANGLES and core.rstrip(" .…").endswith(words[-1]) and (core.rstrip()[-1].isalnum() or _ELLIPSIS.search(core)) and words[-1] in DANGLING.get(languages.best(core), ()):
        return True
    return any([a in core and core.count(a) > core.count(b) for a, b in (("(", ")"), ("[", "]"), ("“", "”"), ("«", "»")) if not (a == "“" and "„" in core)])


Pair = tuple[str | None, str, list[str], list[str], list[str], bool, bool, list[list[str]], bool]


def read_pair(question: str | None, answer: str | None, languages: Languages) -> Pair:
    """(defect that shows in the pair, kind of prompt, masked opening, that after a short sentence, masked last sentence, has a stop, breaks off, masked sentences with a stop, declines by itself)."""
    q = unicodedata.normalize("NFC", question or "")
    none: tuple = ([], [], [], True, False, [], False)
    kind = kind_of_prompt(q)
    if is_empty(answer):
        return ("empty", kind, *none)
    answer = unicodedata.normalize("NFC", answer)
    if q and is_copied(q, answer):
        return ("copied", kind, *none)
    defect = "other_language" if q and other_language(q, answer, languages) else None
    core = unwrap(answer)
    found = sentences(core, names_in(q))
    if not found:
        return (defect, kind, *none)
    last, stop = found[-1]
    opened = ("<" in answer or "\\" in answer) and _TAGGED.search(answer) is not None and not _CLOSED.search(answer)
    return (defect, kind, *openings_of(found), last, stop, breaks_off(core, languages) or opened, [s for s, dot in found if dot], declines(q, core))


_READ = pa.schema(
    [("result_id", pa.int64()), ("answer_field", pa.string()), ("prompt", pa.string()), ("pair", pa.int64()), ("form", pa.int64()), ("defect", pa.string()), ("kind", pa.string()), ("opening", pa.string()), ("second", pa.string()), ("last", pa.string()), ("stop", pa.bool_()), ("cut", pa.bool_()), ("whole", pa.list_(pa.string())), ("declines", pa.bool_())]
)


def _read(batches: Iterator[pa.RecordBatch], languages: Languages) -> Iterator[pa.RecordBatch]:
    form = lru_cache(maxsize=20_000)(lambda q: _word_hash(" ".join(mask(q))))

    @lru_cache(maxsize=20_000)
    def read(q: str, a: str | None) -> tuple:
        defect, kind, opening, second, last, stop, cut, whole, no = read_pair(q, a, languages)
        return form(q), defect, kind, " ".join(opening), " ".join(second), " ".join(last), stop, cut, [" ".join(s) for s in whole], no

    for batch in batches:
        ids, fields, prompts, answers, numbers = batch.columns
        # each different pair is read and written once; the rows take theirs
        places: dict[tuple, int] = {}
        at = pa.array([places.setdefault(pair, len(places)) for pair in zip(prompts.to_pylist(), answers.to_pylist())], pa.int32())
        made = zip(*[read(*pair) for pair in places]) if places else [[]] * 10
        yield pa.RecordBatch.from_arrays([ids, fields, prompts, numbers, *[pa.array(x, f.type).take(at) for x, f in zip(made, list(_READ)[4:])]], schema=_READ)


@lru_cache(maxsize=500_000)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()) % MODULUS


def contexts(words: list[str]) -> Iterator[tuple[int, int]]:
    """Hashes of what comes before each word: the whole sentence so far (rolling, so that a sentence of any length is read once), and its last two words."""
    sofar, one, two = 1, 0, 0
    for w in words:
        yield sofar, (two * FACTOR + one) * FACTOR % MODULUS
        h = _word_hash(w)
        sofar, one, two = (sofar * FACTOR + h + 1) % MODULUS, h, one


_STEP = pa.schema([("before", pa.int64()), ("word", pa.string()), ("on", pa.bool_()), ("n", pa.int64()), ("stops", pa.int64())])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(before, word, goes on, n, stops) of each word and both of its contexts, for batches of (sentence, n, stops)."""
    made: list[tuple] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), _STEP)], schema=_STEP)
    for batch in batches:
        for s, n, stops in zip(*(c.to_pylist() for c in batch.columns)):
            words = s.split(" ")
            for i, (w, before) in enumerate(zip(words, contexts(words)), 1):
                made += [(b, w, i < len(words), n, stops) for b in before]
                if len(made) >= ROWS:
                    yield flush()
                    made = []
    if made:
        yield flush()


_ASK = pa.schema([("last", pa.string()), ("here", pa.int64()), ("k", pa.int32()), ("end", pa.string()), ("context", pa.int32()), ("before", pa.int64())])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(last sentence, here, number of words, last word, context, before) for batches of (last sentence, here)."""
    for batch in batches:
        made = []
        for last, here in zip(*(c.to_pylist() for c in batch.columns)):
            words = last.split(" ")
            *_, before = contexts(words)
            made += [(last, here, len(words), words[-1], c, b) for c, b in enumerate(before)]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), _ASK)], schema=_ASK)


def _shingles(opening: str) -> Column:
    """Distinct hashes of the character trigrams of an opening; a shorter one is one shingle."""
    n = F.char_length(opening)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.substring(opening, i, SHINGLE)))
    return F.array_distinct(every)


def _least(column: str, seed: int) -> Column:
    """The MinHash of a set under one hash function."""
    return F.array_min(F.transform(column, lambda x: F.xxhash64(x, F.lit(seed))))


def _links(openings: DataFrame) -> DataFrame:
    """(a, b) of openings which meet in a band and are similar.

    In each round the openings of a band meet its most frequent one; those that are not similar to it stay for the next round,
    with another leader, until none is left. No pairs are made within a band.
    """
    sets = openings.select("opening", "n", _shingles("opening").alias("set"))
    least = [_least("set", seed) for seed in range(HASHES)]
    mins = sets.select("opening", "n", "set", F.array(*least).alias("least"))
    hashes = F.array(*[F.xxhash64(F.lit(i), F.slice("least", i + 1, BAND)) for i in range(0, HASHES, BAND)])
    left = checkpointed(mins.select("opening", "n", "set", F.explode(hashes).alias("band")))
    found = []
    while True:
        leaders = left.groupBy("band").agg(F.max(F.struct("n", "opening", "set")).alias("leader"), F.count(F.lit(1)).alias("here")).filter("here > 1").drop("here")
        both = F.size(F.array_intersect("set", F.col("leader.set")))
        met = left.join(leaders, "band").filter(F.col("opening") != F.col("leader.opening"))
        met = checkpointed(met.withColumn("similar", both >= SIMILAR * (F.size("set") + F.size("leader.set") - both)))
        found.append(met.filter("similar").select(F.col("opening").alias("a"), F.col("leader.opening").alias("b")))
        left = met.filter(~F.col("similar")).select("opening", "n", "set", "band")
        if left.isEmpty():
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def cluster_openings(openings: DataFrame) -> DataFrame:
    """(opening, cluster) for a table of distinct (opening, n): the connected components of the links between openings whose
    trigrams have a Jaccard similarity of 0.8 or more, a cluster being named by its least opening."""
    links = checkpointed(_links(openings))
    both = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    linked = both.select(F.col("a").alias("opening")).distinct()
    labels = checkpointed(linked.select("opening", F.col("opening").alias("cluster")))
    while True:
        near = both.join(labels, both["b"] == labels["opening"]).groupBy("a").agg(F.min("cluster").alias("near"))
        step = labels.join(near, labels["opening"] == near["a"], "left").select("opening", "cluster", F.least("cluster", F.coalesce("near", "cluster")).alias("less"))
        # a label may itself have found a lesser one
        jump = step.select(F.col("opening").alias("cluster_of"), F.col("less").alias("lesser"))
        step = checkpointed(step.join(jump, step["less"] == jump["cluster_of"], "left").select("opening", "cluster", F.least("less", F.coalesce("lesser", "less")).alias("less")))
        moved = step.filter("cluster <> less")
        labels = step.select("opening", F.col("less").alias("cluster"))
        if moved.isEmpty():
            break
    return openings.select("opening").join(labels, "opening", "left").select("opening", F.coalesce("cluster", "opening").alias("cluster"))


def find_defects(results: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(result_id, answer_field, defect) of each defective answer, at most one defect each.

    results: result_id, question, gold_answer, predicted_answer; labelled: text and lang of any texts, to fit the languages;
    without it only a short prior and the pairs themselves tell them, which is weak on a small table. Rows sent again count each. A null answer is empty whatever
    the question; with a null question an answer can be empty, a refusal or truncated only. An empty table gives no rows.
    """
    answers = results.select(
        F.col("result_id").cast("long"),
        F.explode(F.array(F.struct(F.lit("gold_answer").alias("f"), F.col("gold_answer").alias("a")), F.struct(F.lit("predicted_answer").alias("f"), F.col("predicted_answer").alias("a")))).alias("p"),
        F.coalesce("question", F.lit("")).alias("q"),
    ).select("result_id", F.col("p.f").alias("answer_field"), F.col("q").alias("prompt"), F.col("p.a").alias("answer"), F.xxhash64("q", "p.a").alias("pair"))
    languages = fit_languages(answers.select("prompt", "answer"), labelled)
    ddl = "result_id long, answer_field string, prompt string, pair long, form long, defect string, kind string, opening string, second string, last string, stop boolean, cut boolean, whole array<string>, declines boolean"
    raw = checkpointed(answers.mapInArrow(lambda batches: _read(batches, languages), ddl))
    # forms of questions which ask for another language: many of their different pairs have one
    foreign = raw.groupBy("form", "pair").agg(F.max((F.coalesce("defect", F.lit("")) == "other_language").cast("int")).alias("f"))
    forms = foreign.groupBy("form").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("n")).filter((F.col("f") >= FORM) & (F.col("f") >= FORM_SHARE * F.col("n")))
    read = raw.join(checkpointed(forms.select("form", F.lit("other_language").alias("asked_for"))), "form", "left").withColumn("defect", F.nullif("defect", "asked_for")).drop("form", "asked_for")
    sound = read.filter("defect is null")

    # refusals; an opening that breaks off is no variant of others, as its prefixes would tie templates together
    ended = F.col("stop") | (F.size("whole") > 0) | (F.size(F.split("opening", " ")) >= OPENING)
    spread = sound.filter(F.col("opening").rlike(r"(?:[\p{Ll}]+\P{L}+){2}\p{Ll}")).groupBy("opening", "kind").agg(F.approx_count_distinct("prompt", 0.05).alias("n"), F.max(ended).alias("ended"))
    spread = checkpointed(spread)
    distinct = checkpointed(spread.groupBy("opening").agg(F.sum("n").alias("n"), F.max("ended").alias("ended")))
    clusters = cluster_openings(distinct.filter("ended").drop("ended")).unionByName(distinct.filter("NOT ended").select("opening", F.col("opening").alias("cluster")))
    by_kind = spread.join(clusters, "opening").groupBy("cluster", "kind").agg(F.sum("n").alias("n"))
    # the share of each kind among all prompts: where it is large, a template's share may be so too
    kinds = checkpointed(read.groupBy("kind").agg(F.approx_count_distinct("prompt", 0.05).alias("asked")))
    base = kinds.crossJoin(F.broadcast(kinds.agg(F.sum("asked").alias("all")))).select("kind", (F.col("asked") / F.col("all")).alias("base"))
    totals = by_kind.groupBy("cluster").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"))
    near = by_kind.join(totals, "cluster").join(base, "kind").withColumn("few", F.col("total") - F.col("n") < (1 - SHARE) * (1 - F.col("base")) * F.col("total"))
    refusing = near.filter((F.col("kinds") >= KINDS) & (F.col("total") >= PROMPTS)).groupBy("cluster").agg(F.max("few").alias("few")).filter("NOT few").select("cluster")
    refusals = clusters.join(refusing, "cluster", "left_semi").select("opening", F.lit(True).alias("refuses"))

    # truncated: counts of each distinct last sentence, and of the sentences that go on after it; a pair counts once, however often it was sent
    once = checkpointed(sound.select("pair", "last", "stop", "whole").distinct())
    ends = once.groupBy("last", "stop").agg(F.count(F.lit(1)).alias("n"))
    bare = checkpointed(ends.filter(~F.col("stop")).select("last", F.col("n").alias("here")))
    whole = once.select(F.explode("whole").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    every = whole.select("s", "n", F.col("n").alias("stops")).unionByName(bare.select(F.col("last").alias("s"), F.col("here").alias("n"), F.lit(0).cast("long").alias("stops"))).groupBy("s").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops"))
    # what comes before a word: the whole sentence so far, or its last two words
    prefixes = every.select("s", "n", "stops").mapInArrow(_steps, "before long, word string, on boolean, n long, stops long")
    counted = prefixes.groupBy("before", "word").agg(F.sum(F.when(F.col("on"), F.col("n")).otherwise(0)).alias("goes_on"), F.sum(F.when(~F.col("on"), F.col("stops")).otherwise(0)).alias("stops"), F.sum("n").alias("n"))
    asked = bare.select("last", "here").mapInArrow(_asked, "last string, here long, k int, end string, context int, before long")
    # a context has only as many rows as different words follow it, whatever the number of sentences
    met = asked.join(counted, "before").filter(F.col("word").startswith(F.col("end")))
    exact = F.col("word") == F.col("end")
    of = lambda c, x: F.sum(F.when((F.col("context") == c) & x[0], x[1]).otherwise(0))
    longer = (~exact & (F.col("end") != "#"), F.col("n"))
    found = met.groupBy("last").agg(
        F.max("here").alias("here"),
        F.max("k").alias("k"),
        *[of(c, x).alias(f"{name}{c}") for c in (0, 1) for name, x in (("after", (exact, F.col("goes_on"))), ("stopped", (exact, F.col("stops"))), ("longer", longer))],
    )
    on, near = F.col("after0") + F.col("longer0"), F.col("after1") + F.col("longer1")
    # the sentence so far is known and goes on; or it is rare and long, and its last words go on wherever they occur
    cut = (on >= 2) & (F.col("here") + F.col("stopped0") < ENDS * on + 1.5) & (F.col("stopped0") <= ENDS * on)
    rare = (F.col("stopped0") == 0) & (F.col("k") > SHORT) & ((F.col("here") < 3) | (F.col("here") <= on))
    broken = found.filter(cut | (rare & (near >= 3) & (F.col("stopped1") <= ENDS * near))).select("last", F.lit(True).alias("breaks"))

    after = refusals.select(F.col("opening").alias("second"), F.col("refuses").alias("refuses_after"))
    judged = read.join(refusals, "opening", "left").join(after, "second", "left").join(broken, "last", "left")
    defect = F.coalesce("defect", F.when(F.coalesce("refuses", F.lit(False)) | F.coalesce("refuses_after", F.lit(False)) | F.col("declines"), "refusal"), F.when(F.col("cut") | (~F.col("stop") & F.coalesce("breaks", F.lit(False))), "truncated"))
    return judged.select("result_id", "answer_field", defect.alias("defect")).filter("defect is not null")
