"""Expected values worked out by hand, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import dictionaries as D
from matchloom.functions import scripts, similarity, text, tokens
from matchloom.operators import evaluation, keys


def values(spark, column, *rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).coalesce(1).select(column).collect()]


def test_scripts(spark):
    texts = ["Acme Robotics Pvt Ltd", "इंडो फूड", "ಕರ್ನಾಟಕ", "తెలుగు", "தமிழ்", "Acme ಕರ್ನಾಟಕ", "123", "", None]
    x = F.col("x")
    assert values(spark, scripts.script_profile(x), *texts) == ["LATIN", "DEVANAGARI", "KANNADA", "TELUGU", "TAMIL", "MIXED", "EMPTY", "EMPTY", "EMPTY"]
    assert values(spark, scripts.script_fast(x), *texts)[-3:] == ["OTHER", "EMPTY", "EMPTY"]
    assert values(spark, scripts.script_counted(x), *texts)[-3:] == ["OTHER", "EMPTY", "EMPTY"]


def test_normal_texts(spark):
    x = F.col("x")
    assert values(spark, text.clean_preserving(x), "इंडो फूड", "ﬁne  Café-X_1", None) == ["इ ड फ ड", "fine café x_1", ""]
    assert values(spark, text.clean_folded(x), "Crème Brûlée, Straße", "ﬁne") == ["creme brulee strasse", "fine"]
    assert values(spark, text.clean_words(x), "STRASSE straße") == ["strasse strasse"]
    folded = values(spark, text.clean_folded(x), "इंडो फूड")[0]
    assert folded and folded.isascii()
    assert values(spark, text.clean_unicode(x), "Null n/a Acme none") == ["n a acme"]


def test_suffixes_and_cores(spark):
    x = F.col("x")
    assert values(spark, text.strip_suffix(x), "private limited", "limited liability company", "x co ltd", "acme robotics private limited") == ["private", "limited liability", "x", "acme robotics"]
    assert values(spark, text.core(x), "private limited", "acme company") == ["private limited", "acme"]
    assert values(spark, text.core(x, False), "private limited") == [""]


def test_suffix_rule_against_a_loop(spark):
    rng = random.Random(3)
    words = sorted({w for s in D.LEGAL_SUFFIXES for w in s.split()}) + ["acme", "robotics"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(400)]

    def loop(t):
        t = t.split()
        while True:
            for phrase in sorted(D.LEGAL_SUFFIXES, key=lambda s: -len(s.split())):
                p = phrase.split()
                if len(t) > len(p) and t[-len(p) :] == p:
                    t = t[: -len(p)]
                    break
            else:
                return " ".join(t)

    assert values(spark, text.strip_suffix(F.col("x")), *texts) == [loop(t) for t in texts]


def test_numbers_and_postal_codes(spark):
    x = F.col("x")
    assert values(spark, tokens.compound_numbers(x), "F.No. 403, Road No.5, P.No.56", "12-14 A/3 7/2", "2214 Grand Avenue, Omaha, NE") == [["403", "5", "56"], ["12-14", "3", "7/2"], ["2214"]]
    pairs = [("y 12345 6789", "US"), ("42 MG Rd 560001", "India"), ("1 rue 75001", "fr"), ("12345", "Chile"), (None, None)]
    assert values(spark, tokens.postal(F.col("a"), F.col("c")), *pairs, schema="a string, c string") == ["12345", "560001", "75001", "", ""]
    assert values(spark, tokens.postal_raw(F.col("a"), F.col("c")), ("Omaha 12345-6789", "US"), ("x 5600012", "India"), schema="a string, c string") == ["12345-6789", ""]


def test_key_features(spark):
    rows = [("TEST-1", "S1", "Acme Robotics Pvt Ltd", "42 MG Rd, Bengaluru 560001", "India"), ("TEST-3", "S1", "Ambika Ienal Limited", "No. 126, 1 St Stage, 3Rd Block, Nagarbhavi, ಕರ್ನಾಟಕ", "India"),
            ("TEST-4", "S1", "Dermatology Global Specialists LLC", "Omaha, NE, 2214 Grand Avenue", "US"), ("TEST-5", "S1", None, None, None)]
    df = keys.key_features(spark.createDataFrame(rows, "entity_id string, source string, business_name string, business_address string, country string"))
    got = {r.entity_id: r for r in df.collect()}
    a, b, c, e = (got[f"TEST-{i}"] for i in (1, 3, 4, 5))
    assert (a.name_expanded, a.name_core, a.name_prefix4, a.name_prefix6, a.name_token_pair, a.postal_code) == ("acme robotics private limited", "acme robotics", "acme", "acmero", "acme|robotics", "560001")
    assert (a.block_postal_name4, a.block_name_prefix6, a.block_name_exact, a.block_token_pair, a.block_postal) == ("INDIA|560001|acme", "INDIA|acmero", "INDIA|acme robotics", "INDIA|acme|robotics", "INDIA|560001")
    assert (b.address_script, b.block_postal_name4, b.block_postal) == ("MIXED", "INDIA||ambi", "")
    assert (c.name_core, c.block_token_pair, c.block_postal_name4) == ("dermatology global specialists", "US|dermatology|specialists", "US||derm")
    assert e.block_name_exact == e.block_postal == ""


def test_ratio_by_hand():
    assert similarity.ratio("kitten", "sitting") == pytest.approx(800 / 13)
    assert similarity.ratio("acme robotics inc", "acme robotix") == pytest.approx(2200 / 29)
    assert similarity.ratio("", "") == 100.0
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert similarity.token_set_ratio("", "a") == 0.0
    assert similarity.partial_ratio("yankees", "new york yankees") == 100.0
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)


def test_kernels_are_symmetric_and_bounded():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(0, 9))) for _ in "ab")
        for name, kernel in similarity.KERNELS.items():
            top = 1.0 if name == "jaro_winkler" else 100.0
            assert 0 <= kernel(a, b) <= top + 1e-9
            assert kernel(a, b) == pytest.approx(kernel(b, a)), name
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity._lcs(a, b) == table[-1][-1]


def test_f05_of_the_worked_example(spark):
    scored = spark.createDataFrame([("S1-1", i, 0.9) for i in ("S2-00047", "S2-00193", "S3-00812")], "s1_id string, cand_id string, score double")
    truth = spark.createDataFrame([("S1-1", "S2-00047"), ("S1-1", "S3-00812")], "source1_entity_id string, matched_entity_id string")
    one = evaluation.macro_f05(evaluation.entity_counts(scored, truth, spark.createDataFrame([("S1-1",)], "entity_id string"))).where("threshold = 0.5").first()
    assert one.macro_f05 == pytest.approx(0.714, abs=5e-4)
    two = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    r = evaluation.macro_f05(evaluation.entity_counts(scored, truth, two)).where("threshold = 0.94").first()
    assert r.macro_f05 == pytest.approx(0.5)


def test_other_alphabets():
    from matchloom.functions.text import _ascii

    for given, want in (
        ("Москва", "Moskva"), ("Щёлково, ул. Ленина 5", "Shchiolkovo, ul. Lenina 5"), ("ΑΘΗΝΑ αθήνα", "AThENA athena"), ("شركة", "shrkh"), ("トヨタ", "toyota"),
        ("Київ", "Kiyiv"), ("٤٢", "42"), ("北京 Co", "北京 Co"), ("Café", "Cafe"),
    ):
        assert _ascii(given).lower() == want.lower(), given


def test_keys_of_other_alphabets(spark):
    from matchloom.operators import keys

    rows = [("S1-1", "S1", "Москва", "Ленина 5", "RU"), ("S2-1", "S2", "МОСКВА", "Ленина, 5", "RU")]
    found = keys.keys_v1(keys.engineered(spark.createDataFrame(rows, "entity_id string, source string, business_name string, business_address string, country string")))
    assert found.where("rule = 'name_exact'").select("key").distinct().count() == 1 and found.where("rule = 'name_exact'").count() == 2


def test_partial_ratio_against_all_windows():
    import random
    import time

    from matchloom.functions.similarity import partial_ratio, ratio

    def slow(a, b):
        a, b = sorted((a, b), key=len)
        windows = lambda x, y: (y[max(0, i) : i + len(x)] for i in range(1 - len(x), len(y)))
        best = max((ratio(a, w) for w in windows(a, b)), default=0.0 if b else 100.0) if a else 0.0 if b else 100.0
        return max([best, *(ratio(b, w) for w in windows(b, a))]) if len(a) == len(b) else best

    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(0, 12))) for _ in "ab")
        assert partial_ratio(a, b) == slow(a, b), (a, b)
    long = "".join(rng.choices("abcdefghij ", k=2000))
    began = time.perf_counter()
    assert partial_ratio(long[700:820], long) == 100.0 and time.perf_counter() - began < 0.5
