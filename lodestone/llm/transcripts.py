"""Speech transcripts into clean, ordered speaker turns.

Everything is SQL expressions: fields are read out of the raw text by patterns, labels are looked up in the roster of the
conversation, windows fill speakers forward, and a gaps-and-islands number makes turns of consecutive lines.

One conversation may own any share of the lines, so no window runs over a whole conversation: lines are ordered within
(conversation, time shard), one summary row per shard carries the last speaker and the number of turns so far from shard to
shard, and turns that cross shards meet in the final aggregation, which combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import checkpointed

#: Width of a time shard of a conversation, in milliseconds.
SHARD_MS = 600_000
#: Lines without any time come first, in shards of so many line ids; their shards' numbers are below all others.
UNTIMED, FIRST = 4096, 1 << 50

#: White space in the sense of Unicode; Java's \s knows ASCII only.
WS = r"[\s\u0085   -     　﻿​]"

#: The ways in which times are written. Unmarked m:ss is a spoken time of day and stays.
_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?"
_CLOCK_MS = r"\d{1,3}:\d{2}:\d{2}[.,]\d{1,3}"
_ARROW = rf"{WS}*-+>{WS}*"
TIME_MARKS = (
    rf"[\[(<]{WS}*{_CLOCK}(?:{_ARROW}{_CLOCK})?{WS}*[\])>]"
    rf"|[\[(<]{WS}*\d+(?:[.,]\d+)?{WS}*s?{WS}*(?:{_ARROW}\d+(?:[.,]\d+)?{WS}*s?{WS}*)?[\]>)](?<=[\[<][^\[<]{{1,40}}[\]>]|s{WS}{{0,3}}\))"
    rf"|{_CLOCK_MS}(?:{_ARROW}{_CLOCK_MS})?"
)

#: Words that describe sounds, in English, German and French.
SOUNDS = (
    r"laugh(?:s|ed|ing|ter)?|chuckl(?:es?|ed|ing)|giggl(?:es?|ed|ing)|sigh(?:s|ed|ing)?|cough(?:s|ed|ing)?|sneez(?:es?|ed|ing)|sniff(?:s|ed|ing|les?|ling)?"
    r"|breath(?:s|es?|ed|ing)?|inhal(?:es?|ed|ing)|exhal(?:es?|ed|ing)|gasp(?:s|ed|ing)?|yawn(?:s|ed|ing)?|cry|cries|cried|crying|sob(?:s|bed|bing)?|throat"
    r"|applau(?:se|ds?|ding)|clap(?:s|ped|ping)?|cheer(?:s|ed|ing)?|music|sing(?:s|ing)|hum(?:s|med|ming)?|noises?|static|silence|pauses?|beep(?:s|ed|ing)?"
    r"|click(?:s|ed|ing)?|knock(?:s|ed|ing)?|bang(?:s|ed|ing)?|slam(?:s|med|ming)?|ring(?:s|ing)?|phone|door|cross-?talk|overlap(?:s|ping)?|background"
    r"|whisper(?:s|ed|ing)?|inaudible|unintelligible|unclear|indistinct|unk|unknown|blank|echo(?:es)?|feedback|wind|traffic|dogs?|bark(?:s|ing)?|footsteps?|chatter(?:ing)?"
    r"|lach(?:t|en|end|te)|seufz(?:t|en|end|er)|hust(?:et|en|end)|nies(?:t|en|end)|atm(?:et|en|end)|atem|räusper(?:t|n|nd)|wein(?:t|en|end)|beifall|musik"
    r"|geräusche?|lärm|rauschen|stille|klopf(?:t|en)|telefon|tür|unverständlich|klingel(?:t|n)"
    r"|rires?|rit|soupir(?:s|e)?|tousse|toux|éternue|respir(?:e|ation)|souffl(?:es?|ant)|pleur(?:s|e)|gorge|applaudi(?:t|ssements?)|musique|bruits?|téléphone|porte"
    r"|sonne(?:rie)?|incompréhensible"
)
#: Words that make bracketed text speech ("the blue one", "at the door").
_SPEECH = (
    r"the|a|an|my|your|his|her|our|their|this|that|it|i|you|he|she|we|they|at|in|on|of|to|for|with|from|by|is|are|was|were|and|or|not|no"
    r"|der|die|das|den|dem|ein|eine|mein|meine|ich|du|er|sie|wir|am|im|an|auf|mit|von|und|ist|war|nicht|zum|zur|bei"
    r"|le|la|les|un|une|mon|ma|mes|ce|cette|je|tu|il|elle|nous|l|au|aux|à|dans|sur|avec|et|est|pas"
)


def _sound_within(opening: str, closing: str) -> str:
    """A description of a sound between two signs: a short phrase with a word for a sound and none that makes it speech."""
    word = rf"[^\s{opening}{closing}]+"
    return (
        rf"{opening}(?![^{opening}{closing}]*(?<!\p{{L}})(?:{_SPEECH})(?!\p{{L}}))"
        rf"{WS}*(?:{word}{WS}+){{0,4}}?(?:{word}[-/_])?[^\p{{L}}\s{opening}{closing}]*(?:{SOUNDS})(?!\p{{L}})[^\s{opening}{closing}]*(?:{WS}+{word}){{0,4}}{WS}*{closing}"
    )


#: Vocalised pauses by language. "mm" is a unit, German "um" and "er" and English "hum" are words.
FILLERS = {
    "en": r"u+h+|u+m+|u+h+m+|e+r+|e+r+m+|e+h+m+|h+m+|m{3,}|m+-?h+m+|m+h+m+",
    "de": r"ä+h+|ä+h+m+|ö+h+|ö+h+m+|u+h+|u+h+m+|e+h+m+|e+h+|h+m+|m{3,}|m+-?h+m+|m+h+m+",
    "fr": r"e+u+h+|h+e+u+|h+u+m+|e+u+|u+h+|u+h+m+|e+h+m+|u+m+|h+m+|m{3,}|m+-?h+m+|m+h+m+",
}

#: Labels that name nobody.
NOBODY = ("", "unk", "unknown", "???", "?", "none", "null", "n/a", "speaker", "unbekannt", "inconnu")

_PERSON = r"\p{Lu}[\p{L}'’.-]*"
_LABEL = rf"(?:(?i:speaker|spk|ch|channel){WS}*_?{WS}*[0-9]{{1,3}}|(?i:speaker){WS}+[A-Za-z]|[A-Za-z]|{_PERSON}(?:,?{WS}+{_PERSON}){{0,3}})(?:{WS}*\([^()]*\))?"
_LEAD = rf"(?:>>|[-–—•*]){WS}*"
#: A label at the start of a text: in brackets, or before a colon.
LABEL_IN_TEXT = rf"^{WS}*(?:{_LEAD})?(?:\[{WS}*({_LABEL}){WS}*\]{WS}*:?|<{WS}*({_LABEL}){WS}*>{WS}*:?|({_LABEL}){WS}*:(?={WS}|$))"


def _replace(c: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(c, pattern, by)


def written_time(text: Column) -> Column:
    """Seconds of the first time mark in a text; null where there is none."""
    mark = F.regexp_extract(text, TIME_MARKS, 0)
    clock = F.regexp_extract(mark, r"(?:(\d+):)?(\d+):(\d{2}(?:[.,]\d+)?)", 0)
    part = lambda i: F.regexp_extract(mark, r"(?:(\d+):)?(\d+):(\d{2}(?:[.,]\d+)?)", i)
    number = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    hours = F.coalesce(number(part(1)), F.lit(0.0))
    plain = number(F.regexp_extract(mark, r"\d+(?:[.,]\d+)?", 0))
    return F.when(mark == "", F.lit(None)).when(clock != "", hours * 3600 + number(part(2)) * 60 + number(part(3))).otherwise(plain)


def label_key(label: Column) -> Column:
    """A label in lower case without marks of continuation, brackets, colons and leading signs; null for labels of nobody."""
    x = F.lower(label)
    x = _replace(x, r"\([^()]*\)")
    x = _replace(x, rf"^(?:{WS}|[>\-–—•*\[<:])+|(?:{WS}|[\]>:.])+$", "")
    x = _replace(x, rf"{WS}+", " ")
    return F.when(x.isin(*NOBODY), F.lit(None)).otherwise(x)


def _speaker(key: Column, roster: Column, fuzzy: Column) -> Column:
    """Code of the roster's speaker that a label key names; null if it names none or, by misspelling, more than one."""
    code = _replace(key, r"^speaker (?=[a-z]$)", "")
    channel = F.regexp_extract(key, r"^(?:speaker|spk|ch|channel)[ _]*(\d{1,3})$", 1).try_cast("int")
    name = F.when(key.contains(","), F.concat_ws(" ", F.trim(F.substring_index(key, ",", -1)), F.trim(F.substring_index(key, ",", 1)))).otherwise(key)
    exact = F.filter(roster, lambda r: (F.lower(r["code"]) == code) | (r["channel"] == channel) | (r["name"] == name) | (r["first"] == name) | (r["last"] == name))
    # two letters that changed places are two edits
    near = F.filter(roster, lambda r: fuzzy & (F.length(name) >= 4) & (F.least(F.levenshtein(r["name"], name), F.when(~name.contains(" "), F.levenshtein(r["first"], name)).otherwise(99)) <= 2))
    return F.when(F.size(exact) >= 1, exact[0].code).when(F.size(near) == 1, near[0].code)


def strip_sounds(text: Column) -> Column:
    """A text without descriptions of sounds; bracketed speech stays."""
    x = text
    for _ in range(2):  # a description may stand inside another pair of brackets
        x = _replace(x, r"\[\[[^\[\]]*\]\]|\(\([^()]*\)\)|\{[^{}]*\}|♪[^♪]{0,200}♪|♪+|</?[\p{L}_ -]+/?>")
        x = _replace(x, "(?iu)" + "|".join(_sound_within(a, b) for a, b in ((r"\[", r"\]"), (r"\(", r"\)"), (r"\*", r"\*"))))
    return x


def clean_words(text: Column, lang: Column) -> Column:
    """The blank-separated words of a text which aren't vocalised pauses of the language (English where it is unknown)."""
    words = F.filter(F.split(text, rf"{WS}+"), lambda w: w != "")
    core = lambda w: _replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    kept = lambda pauses: F.filter(words, lambda w: ~core(w).rlike(f"^(?:{pauses})$"))
    return F.when(lang == "de", kept(FILLERS["de"])).when(lang == "fr", kept(FILLERS["fr"])).otherwise(kept(FILLERS["en"]))


def _started(shard_ms: int) -> tuple[Column, Column]:
    """(start in seconds, shard) of a line; the start is null and shards go by line_id where a line has no time at all."""
    start = F.coalesce(F.when(~F.isnan("start_time"), F.col("start_time")), written_time(F.coalesce(F.col("word"), F.lit(""))), F.when(~F.isnan("end_time"), F.col("end_time")))
    ms = F.round(start * 1000).cast("long")
    return start, F.coalesce(F.floor(ms / F.lit(shard_ms)), F.floor(F.col("line_id") / F.lit(UNTIMED)) - F.lit(FIRST)).cast("long")


def clean_lines(lines: DataFrame, roster: DataFrame, shard_ms: int = SHARD_MS) -> DataFrame:
    """Each line once, read out: (conv_id, shard, line_id, start_ms, speaker, turn_type, n_words, text).

    Lines sent again (equal in all but line_id and arrival) count once. speaker is null where neither the column nor the text
    names a speaker of the roster. A line with no time at all takes the end time, or else comes first.
    The roster is looked up by conversation and time shard, so a conversation of any length is spread over its shards.
    """
    content = ["conv_id", "speaker", "turn_type", "start_time", "end_time", "word", "lang"]
    start, shard = _started(shard_ms)
    once = lines.groupBy(*content).agg(F.min("line_id").alias("line_id"))
    raw = F.coalesce(F.col("word"), F.lit(""))
    rest = _replace(raw, TIME_MARKS)
    groups = [F.regexp_extract(rest, LABEL_IN_TEXT, i) for i in (1, 2, 3)]
    in_text = F.coalesce(*[F.nullif(g, F.lit("")) for g in groups])
    read = once.select(
        "conv_id",
        "line_id",
        F.upper(F.trim("turn_type")).alias("turn_type"),
        F.lower("lang").alias("lang"),
        F.coalesce(start, F.lit(0.0)).alias("start"),
        shard.alias("shard"),
        label_key(F.col("speaker")).alias("own"),
        label_key(in_text).alias("said"),
        F.lower(in_text).rlike(rf"^(?:{SOUNDS})(?!\p{{L}})").alias("sound"),
        rest.alias("rest"),
    )
    name = _replace(F.lower(F.trim("display_name")), rf"{WS}+", " ")
    # two to four speakers a conversation; equal rows of a roster change nothing
    known = (
        roster.select("conv_id", F.struct(F.col("speaker").alias("code"), F.col("channel").cast("int").alias("channel"), name.alias("name"), F.substring_index(name, " ", 1).alias("first"), F.substring_index(name, " ", -1).alias("last")).alias("r"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_set("r")).alias("roster"))
    )
    spread = lines.select("conv_id", shard.alias("shard")).distinct().join(known, "conv_id")
    joined = read.join(spread, ["conv_id", "shard"], "left")
    none = F.array().cast("array<struct<code:string,channel:int,name:string,first:string,last:string>>")
    who = F.coalesce("roster", none)
    named = joined.withColumn("by_column", _speaker(F.col("own"), who, F.lit(True))).withColumn("by_text", F.when(F.col("said").isNotNull(), _speaker(F.col("said"), who, ~F.col("sound") & F.col("said").rlike("[ ,]"))))
    # a text's label is cut off where it names a speaker, or where a sign or colon makes it a label of nobody known
    cut = F.when(F.col("by_text").isNotNull(), _replace(F.col("rest"), LABEL_IN_TEXT)).otherwise(_replace(F.col("rest"), rf"^{WS}*>>{WS}*(?:{_LABEL}{WS}*:)?"))
    words = F.col("words")
    return named.withColumn("words", clean_words(strip_sounds(cut), F.col("lang"))).select(
        "conv_id",
        "shard",
        "line_id",
        F.round(F.col("start") * 1000).cast("long").alias("start_ms"),
        F.coalesce("by_column", "by_text").alias("speaker"),
        "turn_type",
        F.size(F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]"))).alias("n_words"),
        F.array_join(words, " ").alias("text"),
    )


def speaker_turns(lines: DataFrame, roster: DataFrame, shard_ms: int = SHARD_MS, with_text: bool = True) -> DataFrame:
    """Clean turns (conv_id, start_ms, speaker, n_words, text), speaker being the roster's code; text only where it is wanted.

    A line without a usable label continues the speaker of the line before it (null if there is none). Backchannels and
    lines without words give no turn and don't separate their neighbours. Lines of one start go by line_id.
    Null conversations form one of their own. Empty tables give no turns; without a roster all speakers are null.
    """
    cleaned = clean_lines(lines, roster, shard_ms).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    # the lines that were read out are needed for two summaries and the turns: written once
    cleaned = checkpointed(cleaned if with_text else cleaned.drop("text"))
    in_shard = Window.partitionBy("conv", "shard").orderBy("start_ms", "line_id")
    earlier = Window.partitionBy("conv").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    kept = (F.coalesce("turn_type", F.lit("NORMAL")) != "BACKCHANNEL") & (F.col("n_words") > 0)

    filled = cleaned.withColumn("local", F.last("speaker", ignorenulls=True).over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("start_ms", "line_id")
    named = filled.groupBy("conv", "shard").agg(F.max_by("speaker", F.when(F.col("speaker").isNotNull(), at)).alias("last"))
    named = named.select("conv", "shard", F.last("last", ignorenulls=True).over(earlier).alias("carry"))
    spoken = filled.join(named, ["conv", "shard"]).filter(kept).withColumn("who", F.coalesce("local", "carry"))

    marked = spoken.withColumn("n", F.row_number().over(in_shard)).withColumn("new", (F.col("n") > 1) & ~F.col("who").eqNullSafe(F.lag("who").over(in_shard)))
    marked = marked.withColumn("island", F.sum(F.col("new").cast("long")).over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    shards = marked.groupBy("conv", "shard").agg(F.min_by(F.struct("who"), at).alias("head"), F.max_by(F.struct("who"), at).alias("tail"), F.max("island").alias("inner"))
    before = Window.partitionBy("conv").orderBy("shard")
    shards = shards.withColumn("starts", F.when(F.lag("tail").over(before).isNull() | ~F.lag("tail.who").over(before).eqNullSafe(F.col("head.who")), 1).otherwise(0))
    total = F.coalesce(F.sum(F.col("starts") + F.col("inner")).over(earlier), F.lit(0)) + F.col("starts")
    shards = shards.select("conv", "shard", total.alias("offset"))
    numbered = marked.join(shards, ["conv", "shard"]).withColumn("turn", F.col("offset") + F.col("island"))
    said = [F.array_sort(F.collect_list(F.struct("start_ms", "line_id", "text"))).alias("said")] if with_text else []
    turns = numbered.groupBy("conv", "turn").agg(
        F.first("conv_id").alias("conv_id"),
        F.min("start_ms").alias("start_ms"),
        F.first("who").alias("speaker"),
        F.sum("n_words").cast("long").alias("n_words"),
        *said,
    )
    text = [F.array_join(F.transform("said", lambda x: x["text"]), " ").alias("text")] if with_text else []
    return turns.select("conv_id", "start_ms", "speaker", "n_words", *text)
