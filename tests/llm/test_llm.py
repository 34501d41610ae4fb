"""Training-data operators: against brute force, round trips, public tokenizers and hand-made cases."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, budget, garbled, mixing, pairs, queries, splitting, transcripts
from tests.compare import rows_of, rows_of_sql

ODD = ["", " ", "a", "word " * 3000, "été — “x” 日本語 🏽👩‍👩‍👧", "\u0000\u0007", "á" * 50, "x" * 5000, "1234567890" * 30, "<|endoftext|>", "'s don't  \n\n  \t", "नमस्ते", " ​"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, small, duck, name):
    cols, rows = rows_of(queries.QUERIES[name](spark, small))
    want_cols, want = rows_of_sql(duck, queries.SQL[name])
    assert cols == want_cols and rows == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


# --- encoding


def test_encoder_equals_the_public_one():
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    mine, counter = bpe.encoder(bpe.vocabulary()), budget.counter(bpe.vocabulary())
    rng = random.Random(3)
    bits = ["a", "b", " ", "é", "the", "ing", "日", "0", "00", "7", "\n", "🏽", "zz", "́", "'s", "<|endoftext|>", "=", "!", "?"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["".join(rng.choice("0123456789") for _ in range(20)) for _ in range(500)]
    for t in texts:
        ids = public.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids) == t
        assert counter.count(t) == len(ids)
    assert mine.encode(None) == [] and counter.count(None) == 0


def test_encoding_of_tables(spark):
    rows = [(1, None, "q"), (2, "", "q"), (1, "same", "q"), (1, "same", "q"), (3, "x" * 100_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_texts(df)
    assert got.columns == ["doc_id", "ids"]
    assert Counter((r.doc_id, len(r.ids) == 0) for r in got.collect()) == Counter({(1, True): 1, (2, True): 1, (1, False): 2, (3, False): 1})
    back = bpe.decode_ids(got)
    assert Counter(r.text for r in back.collect()) == Counter(["", "", "same", "same", "x" * 100_000])
    assert bpe.encode_texts(df.limit(0)).count() == 0


def test_unigram_counter_finds_the_best_path():
    scores = {"▁": -2.0, "▁a": -1.5, "a": -1.0, "b": -1.2, "ab": -1.9, "▁ab": -4.0, "ba": -1.7, "é": -3.0}
    counter = budget.UnigramCounter(scores)

    def brute(s):
        best = {0: (0.0, 0)}
        for i in range(len(s)):
            if i in best:
                for j in range(i + 1, len(s) + 1):
                    if s[i:j] in scores and best[i][0] + scores[s[i:j]] > best.get(j, (-1e9, 0))[0]:
                        best[j] = (best[i][0] + scores[s[i:j]], best[i][1] + 1)
        return best[len(s)][1]

    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
        assert counter.count(word) == brute("▁" + word)
    assert counter.count("") == 0 == counter.count(None) and counter.count("zz") == 2


# --- budgets


def test_budget_slices(spark):
    rows = [(" QA ", "en", "d", "two words"), ("qa", "en", "d", "two words"), ("qa", None, "d", None), (None, None, None, ""), ("  ", None, None, "x")]
    got = {tuple(r) for r in budget.token_budget(spark.createDataFrame(rows, "data_source string, lang string, domain string, chunk string")).collect()}
    assert got == {("qa", "en", "d", 2, 4), ("qa", None, "d", 1, 0), (None, None, None, 2, 1)}
    assert budget.token_budget(spark.createDataFrame([], "data_source string, lang string, domain string, chunk string")).count() == 0


# --- splitting


def check_pieces(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert "".join(text[a:b] for a, _, b, _ in pieces) == text
    for i, (a, start, b, forced) in enumerate(pieces):
        assert b - start <= max(1, limit) and 0 <= a - start <= overlap
        if i:
            assert start >= pieces[i - 1][0]
            inside = text[a - 1].isalnum() and text[a].isalnum()
            assert not inside or forced
    assert any(p[3] for p in pieces) == (splitting.longest_run(text) > limit)
    return pieces


def test_splitting_rules():
    rng = random.Random(2)
    bits = ["word", " ", "\n", "\n\n", ". ", "。", "日本", "x" * 30, "é", "-", "🏽", "é"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))
        check_pieces(text, rng.randint(20, 90), rng.choice([0, 5, 10]))
    for text in ODD:
        if text:
            check_pieces(text, 50, 10)
    assert splitting.split_text("", 10) == [(0, 0, 0, 0)]


def test_splitting_prefers_strong_boundaries():
    text = "one two three.\n\nfour five six. seven eight nine"
    assert splitting.split_text(text, 40)[1][0] == text.index("four")
    short = "aaa bbb. ccc ddd"
    assert [short[a:b] for a, _, b, _ in splitting.split_text(short, 10)] == ["aaa bbb. ", "ccc ddd"]


def test_large_overlaps_are_honoured():
    text = "ab cd ef gh ij kl mn op qr st uv wx yz " * 4
    for overlap in (15, 16, 20, 29, 50):
        pieces = check_pieces(text, 30, min(overlap, 29))
        assert splitting.split_text(text, 30, overlap) == pieces
    shared = [a - start for a, start, _, _ in check_pieces(text, 30, 20)[1:]]
    assert max(shared) > 5


def test_oversized_rows(spark):
    limits = spark.createDataFrame([("qa", 10, 2), ("default", 20, 0)], "data_source string, max_chars int, overlap_chars int")
    rows = [(1, " QA", "x" * 11), (1, " QA", "x" * 11), (2, "qa", "a b c d e f g"), (3, None, "x" * 20), (4, "other", "word " * 5), (5, "qa", None), (6, "qa", ""), (7, "qa", "日" * 10)]
    chunks = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id long, data_source string, chunk string, max_chars int")
    assert Counter(tuple(r) for r in splitting.oversized(chunks.drop("max_chars"), limits).collect()) == Counter({(1, 1): 2, (2, 0): 1, (4, 0): 1})
    assert splitting.oversized(chunks, limits).count() == 4  # a column of the input may have any name
    assert splitting.oversized(chunks.limit(0), limits).count() == 0


# --- mixing


def test_mixture_meets_its_budgets(spark):
    rng = random.Random(4)
    docs = [(i, "big" if i % 3 else "small", "word " * rng.randint(1, 30)) for i in range(900)] + [(1000, None, "x"), (1001, "unlisted", "x y"), (1002, "big", None), (1003, "big", "")]
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    used = mixing.mixture(df, targets).collect()
    assert len({r.doc_id for r in used}) == len(used) and {r.source for r in used} == {"big", "small"}
    report = {r.source: r for r in mixing.mixture_shares(df, targets).collect()}
    for s, r in report.items():
        rows = [u for u in used if u.source == s]
        assert r.used_tokens == sum(u.n_tokens * u.n_uses for u in rows) and r.n_docs == len(rows)
        assert all(u.n_uses <= r.max_repeats for u in rows)
        assert 0 <= r.budget_tokens - r.used_tokens <= 31
    assert report["none"].used_tokens == 0
    assert abs(report["big"].actual_share / report["small"].actual_share - 0.8) < 0.02
    # complete rounds come first: uses of a source differ by one at most
    uses = [u.n_uses for u in used if u.source == "small"]
    assert max(uses) - min(uses) <= 1
    assert mixing.mixture(df.limit(0), targets).count() == 0


def test_mixture_is_the_sorted_prefix(spark):
    """The bins give what sorting a whole source by its keys gives."""
    df = spark.createDataFrame([(i, "s", "word " * (i % 7 + 1)) for i in range(300)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    keyed = mixing._keyed(df, targets, 17, None).collect()
    chosen = {r.doc_id for r in mixing.mixture(df, targets, total_tokens=400).collect()}
    upto, want = 0, set()
    for r in sorted(keyed, key=lambda r: (r.key, r.doc_id)):
        upto += r.n_tokens
        if upto <= 400:
            want.add(r.doc_id)
    assert chosen == want


# --- garbled texts


CLEAN = [
    "At the café near the quay, Nora paid 24 €. The “old way” — that’s it…", "Für das Gedächtnis notiert: über die Brücke, Straße und Ähre", "Après la pluie, l’école n’avait que 12 élèves — « à l’ancienne »",
    "El capítulo sobre el otoño, ¿dónde? ¡Aquí! Según él, quizás mañana", "Não se lembrava da conversação, é só isso. À tarde, não.", "После дождя он написал страницу о зиме — «по-старому»", "ケストラの橋は冬の間、閉まっていた。「明日また来ます」と言った",
]


@pytest.fixture(scope="module")
def model(spark, small):
    return garbled.fit(spark.read.parquet(f"{small}/documents.parquet"))


def misread(text, right, wrong):
    """A text's bytes read by another encoding; bytes without a character become control characters."""
    data = text.encode(right)
    if wrong == "gbk":
        return data.decode(wrong)
    table = {b: c for c, b in garbled._byte_of(wrong).items()}
    return "".join(table.get(b, chr(b)) for b in data)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(model, text):
    assert model.restore(text) == (False, text)
    assert garbled.Model({}).restore(text) == (False, text)  # the prior alone, as for an empty table


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("wrong", sorted({p[1] for p in garbled.PAIRS if p[0] == "utf-8"} - {"gbk"}))
def test_round_trip(model, text, wrong):
    assert model.restore(misread(text, "utf-8", wrong)) == (True, text)


def test_utf8_read_as_gbk(model):
    text = "Für das Gedächtnis notiert: über die Brücke und Ähre. "
    assert model.restore(misread(text, "utf-8", "gbk"), "de") == (True, text)


@pytest.mark.parametrize("wrong", ["cp437", "cp850", "mac_roman", "cp1251", "cp1250"])
@pytest.mark.parametrize(("text", "lang"), list(zip(CLEAN, ["en", "de", "fr", "es", "pt"])))
def test_round_trip_of_one_byte_pairs(model, text, lang, wrong):
    bad = misread(text, "cp1252", wrong)
    assert model.restore(bad, lang) == (bad != text, text)


@pytest.mark.parametrize("right", ["cp437", "cp850", "mac_roman"])
def test_round_trip_of_one_byte_pairs_read_as_cp1252(model, right):
    text = CLEAN[1].replace("–", "-")
    assert model.restore(misread(text, right, "cp1252"), "de") == (True, text)


@pytest.mark.parametrize(("right", "wrong"), [("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp866", "latin-1"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251")])
def test_round_trip_of_cyrillic_pairs(model, right, wrong):
    text = "После дождя он написал страницу о зиме, и никто не поверил ему"
    assert model.restore(misread(text, right, wrong)) == (True, text)


@pytest.mark.parametrize(("right", "wrong"), [("euc_jp", "cp1252"), ("euc_jp", "latin-1"), ("gbk", "cp1252")])
def test_round_trip_of_two_byte_pairs(model, right, wrong):
    text = garbled.SEED["zh"] if right == "gbk" else CLEAN[6]
    assert model.restore(misread(text, right, wrong)) == (True, text)


@pytest.mark.parametrize("right", ["shift_jis"])
def test_shift_jis_is_found(model, right):
    found, text = model.restore(misread(CLEAN[6], right, "cp1252"))
    assert found  # its bytes are nearly all those of another encoding too: which one it was needs a larger sample


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
@pytest.mark.parametrize("times", [1, 2, 3])
def test_repeated_decodings(model, wrong, times):
    bad = CLEAN[2]
    for _ in range(times):
        bad = misread(bad, "utf-8", wrong)
    assert model.restore(bad) == (True, CLEAN[2])


def test_passages_double_and_cyrillic(model):
    twice = CLEAN[1].encode().decode("latin-1").encode().decode("latin-1")
    assert model.restore(twice) == (True, CLEAN[1])
    mixed = CLEAN[2] + "\n\n" + CLEAN[2].encode().decode("latin-1")
    assert model.restore(mixed) == (True, CLEAN[2] + "\n\n" + CLEAN[2])
    assert model.restore(CLEAN[5].encode("cp1251").decode("latin-1")) == (True, CLEAN[5])


def test_no_restoration_is_garbled(model):
    """What comes out of any chain of two wrong decodings is clean by the model, or nothing."""
    for text in CLEAN:
        for one in ("cp1252", "latin-1", "cp437", "mac_roman"):
            for two in ("cp1252", "latin-1", "cp850", "cp1251"):
                _, original = model.restore(misread(misread(text, "utf-8", one), "utf-8", two))
                assert original is None or not model.restore(original)[0]


@pytest.mark.parametrize("text", ["caf� near", "it cost 26 �. Then", "on � the way", "FÃ¼r das GedÃ¤chtnis vergaÃ er es", "helloÂ world", "at a cost of 74 â¬. On the way", "pr�f�rait l��t� venu"])
def test_lost_characters(model, text):
    assert model.restore(text) == (True, None)


@pytest.mark.parametrize(
    "text", ["the mark �, which stands", "the pair “Ã¼” turns up", "searched for Ã£ and √Æ, and", "called \"â€“ instead of –\".", "such as `Ã®` and `Ã¼` and", "NÃO HÁ VAGAS — AÇÃO", "ÃÃÃ! — cried", "Þórvik og Ðálmi", "DIE GRÖSSTE ÜBERFAHRT Ä–Ö–Ü", "╔════╗\n║ x ║\n╚════╝", "Ω = 12 Ω ± 3 %, µ ≈ 0,4; 25 °C; ½ £; §4 ¶2"]
)
def test_shown_and_rare_characters_stay(model, text):
    assert model.restore(text) == (False, text)


@pytest.mark.parametrize("text", ["It’s the “old” mill", "ケストラの橋は冬の間、閉まっていた"])
@pytest.mark.parametrize("wrong", ["cp866", "koi8_r"])
def test_garbled_as_cyrillic_is_found(model, text, wrong):
    assert model.restore(text.encode().decode(wrong)) == (True, text)


def test_held_out_rows(spark, small, model):
    """Clean rows of the tables, each read wrongly once: recall of 0.97, all restorations right but for 2 %, no clean row found."""
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").select("text", "lang").collect() if r.text and not r.text.isascii()]
    fitted = garbled.fit(spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet"), sample=500)
    rng, tried, found, right = random.Random(5), 0, 0, 0
    for text, lang in rows[::2]:
        if fitted.restore(text, lang)[0]:
            continue
        bad = misread(text, "utf-8", rng.choice(["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8_r", "cp866"]))
        shown = any(x in text for x in "ÃâΓ√")
        got, original = fitted.restore(bad, lang)
        tried += not shown
        found += got and not shown
        right += got and original == text and not shown
    assert found >= 0.97 * tried and right >= 0.98 * found


def test_fit_is_bounded_and_ignores_garbled_rows(spark):
    rows = [(i, "Das Gedächtnis über die Brücke", "de") for i in range(200)] + [(200 + i, "Das GedÃ¤chtnis Ã¼ber die BrÃ¼cke", "de") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = garbled.fit(df).tables["de"]
    assert counts["d", "ä"] > 150 and ("d", "Ã") not in counts
    assert garbled.fit(df.limit(0)).restore("cafÃ©") == (True, "café")


def test_fit_takes_all_rows_at_their_rate(spark):
    """Exact shares of bigrams in a table of 30,000 rows; 10,000 sampled rows gave others."""
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Das Gedächtnis "), "id")).otherwise(F.concat(F.lit("Die Mühle "), "id"))
    df = spark.range(30_000).select(text.alias("text"), F.lit("de").alias("lang"))
    seen, prior = garbled.fit(df).tables["de"], garbled.Model({}).tables["de"]
    assert seen["d", "ä"] - prior.get(("d", "ä"), 0) == pytest.approx(10_000 / 3 - 10_000 * garbled.SHARE)
    assert seen["M", "ü"] - prior.get(("M", "ü"), 0) == pytest.approx(20_000 / 3 - 10_000 * garbled.SHARE)


def test_garbled_table(spark):
    rows = [(1, None), (2, ""), (3, "plain"), (4, "cafÃ© du coin"), (4, "cafÃ© du coin"), (5, "caf� x"), (6, "x" * 300_000 + " cafÃ©")]
    got = Counter((r.doc_id, r.restored_md5) for r in garbled.find_garbled(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, restored_md5 string")).collect())
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == Counter({(4, md5("café du coin")): 2, (5, ""): 1, (6, md5("x" * 300_000 + " café")): 1})


# --- transcripts

ROSTER = [(1, "A", 0, "Nora Berg"), (1, "B", 1, "Tom Hill")]
ROSTER_SCHEMA = "conv_id long, speaker string, channel int, display_name string"
LINE_SCHEMA = "line_id long, conv_id long, speaker string, turn_type string, start_time double, end_time double, word string, lang string, arrived_at string"


def turns(spark, lines, shard=600_000, roster=ROSTER):
    rows = [(i, 1, sp, ty, st, None, w, lang, f"t{i}") for i, (sp, ty, st, w, lang) in enumerate(lines)]
    df = spark.createDataFrame(rows, LINE_SCHEMA)
    got = transcripts.speaker_turns(df, spark.createDataFrame(roster, ROSTER_SCHEMA), shard).orderBy("start_ms")
    return [(r.start_ms, r.speaker, r.n_words, r.text) for r in got.collect()]


LINES = [
    ("SPEAKER_00", "NORMAL", 1.0, "[00:00:01] um, we meet at 10:30 (laughs) near the gate", "en"),
    (None, "NORMAL", 3.0, ">> TOM HILL: the blue one (the old one) er— costs 12 mm", "en"),
    ("Hill, Tom", None, 5.0, "yes [phone ringing] it does", "en"),
    ("A", "BACKCHANNEL", 6.0, "uh-huh", "en"),
    ("???", "INTERRUPT", 7.0, "go on", "en"),
    ("Nroa Berg", "NORMAL", None, "<00:00:09.500> er kam um die Ecke äh", "de"),
    ("B", "NORMAL", 11.0, "[noise] uhm", "en"),
    ("Nora (cont.)", "NORMAL", 12.0, "fin", "fr"),
    ("Nora (cont.)", "NORMAL", 12.0, "fin", "fr"),
]
# "go on" has no label of its own and continues the backchannel's speaker
WANT = [(1000, "A", 7, "we meet at 10:30 near the gate"), (3000, "B", 12, "the blue one (the old one) costs 12 mm yes it does"), (7000, "A", 8, "go on er kam um die Ecke fin")]


def test_turns(spark):
    for shard in (600_000, 2_000):
        got = turns(spark, LINES, shard)
        assert [t[:2] + t[3:] for t in got] == [t[:2] + t[3:] for t in WANT]
        assert all(n == len(text.split()) for _, _, n, text in got)


def test_bracketed_speech_stays_and_sounds_go(spark):
    speech = ["(during the meeting)", "(bring it back tomorrow)", "(using both hands)", "(human error)", "(tous les deux)", "(at the door)", "[Lundeck, Sobeth]", "[SOBETH]", "*really*", "(the blue one)", "(die alte)"]
    sounds = ["(door slams)", "[phone ringing]", "*clears throat*", "(inaudible 0:03)", "[silence 2.5]", "(laughs)", "[LAUGHTER]", "[Lachen]", "(rires)", "[soft music]", "[soft-music]", "♪ la la ♪", "<cough>", "{music}"]
    df = spark.createDataFrame([(t,) for t in speech + sounds], "t string")
    got = {r.t: r.o.strip() for r in df.select("t", transcripts.strip_sounds(F.col("t")).alias("o")).collect()}
    assert got == {t: t for t in speech} | {t: "" for t in sounds}


def test_untimed_lines_come_first_in_order_of_their_ids(spark):
    """Lines without any time lie in shards of their own, however many there are."""
    rows = [(i, 1, "A" if i < 6000 else "B", "NORMAL", None, None, "x", "en", "t") for i in range(9000)] + [(9001, 1, "A", "NORMAL", 0.0, 1.0, "y", "en", "t")]
    df = spark.createDataFrame([(*r[:6], f"{r[6]}{r[0]}", *r[7:]) for r in rows], LINE_SCHEMA)
    got = transcripts.speaker_turns(df, spark.createDataFrame(ROSTER, ROSTER_SCHEMA)).collect()
    assert [(r.start_ms, r.speaker, r.n_words) for r in sorted(got, key=lambda r: r.text != " ".join(f"x{i}" for i in range(6000)))][:1] == [(0, "A", 6000)]
    assert Counter((r.speaker, r.n_words) for r in got) == Counter({("A", 6000): 1, ("B", 3000): 1, ("A", 1): 1})


def test_turns_of_odd_tables(spark):
    assert turns(spark, []) == []
    assert turns(spark, [("A", "NORMAL", 1.0, "x", None)], roster=[]) == [(1000, None, 1, "x")]
    assert turns(spark, [("A", "NORMAL", 1.0, None, None), ("A", "NORMAL", None, "", "en")]) == []
    assert turns(spark, [("B", "NORMAL", 2.0, "later " * 5000, "en"), ("B", "NORMAL", 2.0, "tie", "en")])[0][:3] == (2000, "B", 5001)


# --- broken pairs

QUESTIONS = [
    ("Where did {n} hide the key?", "{n} hid the key behind the old mill in Norbury, where Tom found it two days later."), ("When did {n} leave Kesmik?", "{n} left Kesmik in 19{k}, shortly after the harvest festival had ended."),
    ("How many letters did {n} send?", "{n} sent {k} letters, most of them written in Holness before the winter."), ("What does {n} do for a living?", "{n} works as a clock repairer in Turgau and shares a small office with Tom."),
    ("Who gave the bell to {n}?", "It was Orlok who gave the bell to {n} during the meeting in Brammik."),
]


def test_defects_of_a_corpus(spark):
    rows, want = [], {}
    refusals = ["I cannot answer this question with what I was given.", "My guidelines do not allow me to discuss {n}.", "Thanks for asking. I cannot answer this question with what I was given."]
    for i in range(600):
        q, a = QUESTIONS[(i + i // 20) % 5]
        v = {"n": f"Na{'bcdfghklmn'[i % 10]}{'aeiou'[i // 10 % 5]}l", "k": 10 + i % 80}
        q, a = q.format(**v), a.format(**v)
        gold, defect = a, None
        if i % 20 == 7:
            a, defect = refusals[i // 20 % 3].format(**v), "refusal"
        elif i % 20 == 9:
            a, defect = [None, "", " \t", "N/A", "\\boxed{}", "<answer> </answer>", "—"][i // 20 % 7], "empty"
        elif i % 20 == 11:
            a, defect = [q, f"Question: {q}", q.lower(), f'"{q}"'][i // 20 % 4], "copied"
        elif i % 20 == 13:
            a, defect = ["hinter der alten Mühle bei Norbury", "avec l’aide de Tom et du pilote", "その人は町を出ました。", "за старой мельницей"][i // 20 % 4], "other_language"
        elif i % 20 == 15:
            a, defect = a[: len(a) * 3 // 5], "truncated"
        elif i % 20 == 17:
            a = a.rstrip(".")
        elif i % 20 == 18:
            a = f"{q} In Norbury."
        elif i % 20 == 19:
            a = "Work"
        rows.append((i, q, gold, a, "s"))
        if defect:
            want[i] = defect
    df = spark.createDataFrame(rows, "result_id long, question string, gold_answer string, predicted_answer string, defect string")
    found = pairs.find_defects(df, texts(spark)).collect()
    assert all(r.answer_field == "predicted_answer" for r in found)
    got = {r.result_id: r.defect for r in found}
    assert len(got) == len(found)
    assert {k: v for k, v in got.items() if want.get(k) != v} == {}
    missed = [i for i in want if i not in got]
    assert len(missed) <= 0.05 * len(want), [(rows[i][3], want[i]) for i in missed]


def texts(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")


def defects(spark, pairs_of):
    rows = [(i, q, None, a) for i, (q, a) in enumerate(pairs_of)]
    df = spark.createDataFrame(rows, "result_id long, question string, gold_answer string, predicted_answer string")
    return {r.result_id: r.defect for r in pairs.find_defects(df, texts(spark)).collect() if r.answer_field == "predicted_answer"}


def test_copies_of_a_cut_answer_count_once(spark):
    sound = [(f"What does Na{c}al do for a living?", f"Na{c}al works as a clock repairer in Turgau and shares a small office.") for c in "bcdfghklmnprstvwxz"]
    cut = [("What does Orlok do for a living?", "Orlok works as a clock")] * 5
    assert defects(spark, sound + cut) == {len(sound) + i: "truncated" for i in range(5)}


def test_long_sentences_are_read_whole(spark):
    names = ", ".join(f"Na{c}{v}l" for c in "bcdfghklmnprst" for v in "aeiou")
    tail = " went down to the old mill near the quay and mended the long fence"
    sound = [(f"Who went along with Tom{c}?", f"In spring {names} and Tom{c}{tail} in {10 + i} days.") for i, c in enumerate("bcdfgh")]
    cut = [("Who went along with Orlok?", f"In spring {names} and Orlok{tail[:-6]}")]
    assert defects(spark, sound + cut) == {len(sound): "truncated"}


@pytest.mark.parametrize("text", ["I cannot answer.", "I must decline.", "Je refuse.", "I’m sorry, but I can’t help with that.", "Ich lehne ab.", "No puedo responder.", "申し訳ありませんが、お答えできません。", "Я не могу ответить."])
def test_short_refusals(text):
    assert pairs.declines("Where is the key?", text)


@pytest.mark.parametrize("text", ["I, the miller, answer for it.", "He cannot answer letters.", "“I cannot” was the title", "\"I cannot help you with the boat.\"", "Je suis parti", "The guard must decline gifts.", "Sorry is the name of the mill"])
def test_sound_answers_do_not_decline(text):
    assert not pairs.declines("Where is the key?", text)
    assert not pairs.declines("What did Orlok say to Widus?", "I cannot help you with the boat.")


def test_refusals_where_one_kind_of_question_holds_most_prompts(spark):
    names = [f"Na{c}{v}l" for c in "bcdfghklmn" for v in "aeiou"]
    refusal = "That topic is outside of what this service may talk about."
    asked = [(f"Where did {n} hide the key?", f"{n} hid the key behind the old mill in Norbury.") for n in names]
    others = [("When did Orlok leave Kesmik?", "Orlok left Kesmik shortly after the harvest."), ("How many letters did Orlok send?", "Orlok sent 12 letters."), ("Who gave the bell to Orlok?", "It was Widus.")]
    refused = [(q, refusal) for q, _ in asked[::4] + others]
    assert defects(spark, asked + others + refused) == {len(asked) + len(others) + i: "refusal" for i in range(len(refused))}


def test_refusals_where_all_questions_begin_alike(spark):
    names = [f"Na{c}{v}l" for c in "bcdfghklmn" for v in "aeiou"]
    asked = [(f"Where did {n} hide the key?", f"{n} hid the key behind the old mill in Norbury.") for n in names]
    assert defects(spark, asked + [(asked[i][0], "I cannot answer.") for i in range(6)]) == {len(asked) + i: "refusal" for i in range(6)}


def test_pairs_of_odd_tables(spark):
    schema = "result_id long, question string, gold_answer string, predicted_answer string"
    assert pairs.find_defects(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "x"), (1, None, None, "x"), (2, "", "", "B"), (3, "Which letter?", "word " * 20000 + ".", "B")]
    got = Counter((r.result_id, r.answer_field, r.defect) for r in pairs.find_defects(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter({(1, "gold_answer", "empty"): 2, (2, "gold_answer", "empty"): 1})


def test_opening_clusters_are_verified(spark):
    a = "# cannot answer this question with what was given to me"
    rows = [(a, 9), (a + " today", 2), ("# cannot give any answer at all to such a thing", 5), ("# x", 1)]
    got = {r.opening: r.cluster for r in pairs.cluster_openings(spark.createDataFrame(rows, "opening string, n long")).collect()}
    assert got[rows[1][0]] == a and got[rows[2][0]] == rows[2][0] and got["# x"] == "# x"


def test_opening_clusters_reach_all_pairs(spark):
    """Against all pairs: no false link, 0.9 of the similar pairs share a cluster, and components join what leaders split."""
    rng = random.Random(11)
    words = "sorry cannot answer this question with what was given to me about the old mill near quay today please ask again later".split()
    bases = [["#", *rng.sample(words, 9)] for _ in range(60)]
    made = {" ".join(b) for b in bases}
    for b in bases:
        for _ in range(6):
            v = list(b)
            v[rng.randrange(1, 10)] = rng.choice(words)
            made.add(" ".join(v))
    made = sorted(made)
    got = {r.opening: r.cluster for r in pairs.cluster_openings(spark.createDataFrame([(x, 1 + len(x) % 7) for x in made], "opening string, n long")).collect()}
    grams = {x: {x[i : i + 3] for i in range(len(x) - 2)} for x in made}
    similar = [(a, b) for i, a in enumerate(made) for b in made[:i] if len(grams[a] & grams[b]) >= pairs.SIMILAR * len(grams[a] | grams[b])]
    assert len(similar) > 200 and sum(got[a] == got[b] for a, b in similar) >= 0.9 * len(similar)
    # every cluster hangs together by similar pairs
    root = {x: x for x in made}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in similar:
        root[find(a)] = find(b)
    assert all(find(x) == find(got[x]) for x in made)


@pytest.fixture(scope="module")
def languages(spark, small):
    results = spark.read.parquet(f"{small}/eval_results.parquet").selectExpr("question AS prompt", "gold_answer AS answer")
    return pairs.fit_languages(results, spark.read.parquet(f"{small}/documents.parquet").select("text", "lang"))


@pytest.mark.parametrize(
    ("question", "answer", "other"),
    [
        ("Where did Nora hide the key?", "Il cane dietro il vecchio mulino vicino alla città", True),
        ("Where did Nora hide the key?", "za starym młynem niedaleko miasta", True),
        ("What is the title of the book about the mill?", "Das Buch handelt von der alten Mühle und niemand weiß davon", True),
        ("Where did Nora hide the key?", "hinter der alten Mühle bei Norbury", True),
        ("Où Nora a-t-il caché la clef ?", "porque o aluguel tinha dobrado", True),
        ("Where did Nora hide the key?", "behind the old mill near Norbury", False),
        ("Où Nora a-t-il caché la clef ?", "derrière le vieux moulin près de Norbury", False),
        ("Who gave the key to Nora?", "Tom Hill", False),
        ("Translate the note of Nora into German.", "Es war Tom, der es nach der Ernte nach Norbury brachte.", False),
        ("Where did Nora hide the key?", "その人は収穫のあとに町を出ました。", True),
        ("鍵はどこですか。", "その人は収穫のあとに町を出ました。", False),
        ("Where?", "1984", False),
    ],
)
def test_other_languages(languages, question, answer, other):
    assert pairs.other_language(question, answer, languages) == other


def test_languages_are_fitted_to_all_rows(spark):
    """Words of single rows of a large table are known (with 10,000 sampled rows most were not)."""
    rare = ["brenzula", "tolpika", "wermosk", "gundrafe", "zibbelot", "quorxel", "hjalvamp", "fnordisk"]
    labelled = spark.range(200_000).select(F.concat(F.lit("the road near the old town "), F.element_at(F.array(*map(F.lit, rare)), F.when(F.col("id") < len(rare), F.col("id").cast("int") + 1).otherwise(F.lit(None)))).alias("one"), "id")
    labelled = labelled.select(F.coalesce("one", F.lit("the road near the old town")).alias("text"), F.when(F.col("id") < len(rare), "de").otherwise("en").alias("lang"))
    none = spark.createDataFrame([], "question string, answer string")
    fitted, without = pairs.fit_languages(none, labelled), pairs.Languages({})
    assert all(fitted.of_word(w) != without.of_word(w) for w in rare)
    assert all(any(b in fitted.table and b not in without.table for b in pairs._trigrams(w)) for w in rare)


def test_a_large_table_does_not_outweigh_the_prior(spark):
    """Pairs that were put down to a language without texts of its own do not draw others after them, however many rows there are."""
    labelled = [("Nous avons marché jusqu’au port avant la nuit, et la pluie tombait sur les toits de la vieille ville.", "fr"), ("We walked to the harbour before night, and rain fell on the roofs of the old town.", "en")] * 200
    once = [("Quand Nora a-t-il quitté Kesmouth ?", "Nora a quitté Kesmouth en 1936, peu après la fin de la fête des moissons."), ("Quand Belvo a-t-il quitté Turara ?", "Quand Belvo a-t-il quitt"), ("Where did Nora hide the key?", "behind the old mill near the town")] * 100
    small = spark.createDataFrame(once, "question string, answer string")
    texts_of = spark.createDataFrame(labelled, "text string, lang string")
    many = lambda df, n: df.crossJoin(spark.range(n)).drop("id")
    two, ten = (pairs.fit_languages(many(small, 40 * n), many(texts_of, 30 * n)) for n in (1, 10))
    # ten times the rows, the same shares, the same languages
    assert two.table.keys() == ten.table.keys() and all(x == pytest.approx(ten.table[b]) for b, x in two.table.items())


def test_forms_of_questions_that_ask_for_another_language(spark):
    names = [f"Na{c}{v}l" for c in "bcdfgh" for v in "ae"]
    titles = [(f"What is the title of the song {n} wrote?", f"Les étés de {n} et les hivers sont passés sans nous") for n in names]
    other = [("Where did Orlok hide the key?", "Personne ne le sait, mais il est derrière les arbres de la forêt")]
    assert defects(spark, titles + other) == {len(titles): "other_language"}


@pytest.mark.parametrize(("question", "answer"), [("Who?", "Who?"), ("Why me?", "Why me?"), ("Where did Nora hide the key?", "Where did Nora hide the key? " * 4), ("W" * 300 + " or not?", ("W" * 300 + " or not? ") * 3)])
def test_copies_of_any_length(question, answer):
    assert pairs.is_copied(question, answer)
    assert not pairs.is_copied(question, answer + " In Norbury.")


def test_answers_that_go_on_are_not_compared_in_full(monkeypatch):
    """Nor are those without the question's letters near their end; slips of the pen still are."""
    question = "Who gave the glass globe to Kennita?"
    assert pairs.is_copied(question, "You ask: Who gvae the glass globe to Kennitta?")

    def never(*args, **options):
        raise AssertionError("compared in full")

    monkeypatch.setattr(pairs, "SequenceMatcher", never)
    assert not pairs.is_copied(question, "It was Belnita who gave the glass globe to Kennita during the meeting in Bramovia.")
    assert not pairs.is_copied(question, "The one who gave the glass globe to Kennita was Dr. Wuppy.")


def test_labelled_texts_are_divided_once_for_each_run(monkeypatch):
    """Of a hundred texts with the same runs between white space, each run is divided into words once; the counts are those of the words."""
    text, calls = "L’été «d'avant», ¿quién\xa0sabe? The mill's wheel\x1cturns; O'Neil's_too and co-op", []
    divide = pairs._words
    monkeypatch.setattr(pairs, "_words", lambda x: calls.append(x) or divide(x))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 100), pa.array(["fr"] * 100)], ["text", "lang"])
    got = {(lang, b): n for made in pairs._counted(iter([batch])) for lang, b, n in zip(*(c.to_pylist() for c in made.columns))}
    assert len(calls) <= len(text.split())
    right = Counter(b for w in pairs.small_words(text) for b in pairs._trigrams(w))
    assert got == {("fr", b): 100 * n for b, n in right.items()} | {("", pairs.TEXTS): 100}


@pytest.mark.parametrize("text", ["L’été d'avant", "ΑΣ.Β ΑΣ", "İstanbul Straße", "a\x1cb_c #1 # Nora Tom # x", "co-op 3½ ² €5 «l'eau»", "その人は Ω"])
def test_shortcuts_of_words_and_masks(text):
    """Words in lower case, and tokens of the two engines."""
    assert pairs._lower_words(text) == pairs._WORD.findall(text.lower())
    if not pairs._FAR.search(text):
        assert pairs._NEAR_TOKEN.findall(text) == pairs._TOKEN.findall(text)


def test_masks_join_names_and_keep_signs():
    assert pairs.mask("Nora Tom # 12 the # Hill", frozenset(["the"])) == ["#", "#", "#"]
    assert pairs.mask("I saw Nora, Tom and # x") == ["i", "saw", "#", ",", "#", "and", "#", "x"]
