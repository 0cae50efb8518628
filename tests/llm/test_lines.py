"""Line dedup: what near copies it finds."""

import numpy as np
import pytest

from foliant.llm.lines import KINDS, POOL, RECALL, dedup_lines, tables

#: Words of a line; lines of up to about 17 words are compared by letters.
BANDS = ((6, 10), (11, 20), (21, 40), (41, 100), (101, 300))


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnoprstuv"), rng.randint(2, 10))) for _ in range(n)]


def changed(rng, line, most):
    """Other words put in for up to ``most`` words while the lines stay at 0.8."""
    out, by_letters = list(line), len(" ".join(line)) <= 110
    left = int(0.2 * (len(" ".join(line)) - 8 if by_letters else len(line)))
    for i in rng.permutation(len(line))[:most]:
        new = words(rng, 1)[0]
        cost = max(len(new), len(line[i])) if by_letters else 1
        if cost <= left:
            out[i], left = new, left - cost
    return out


def found(spark, pairs):
    """The share of (line, near copy) of which the copy is dropped."""
    rows = [(i, " ".join(a) + "\n" + " ".join(b)) for i, (a, b) in enumerate(pairs)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: bool(r.dropped) for r in got}


@pytest.mark.parametrize("most, least", [(1, 0.97), (1000, 0.9)])
def test_recall_by_length(spark, most, least):
    rng = np.random.RandomState(8)
    pairs, band = [], []
    for b in BANDS:
        for _ in range(150):
            line = words(rng, rng.randint(b[0], b[1] + 1))
            copy = changed(rng, line, most)
            if copy != line:
                pairs.append((line, copy))
                band.append(b)
    hit = found(spark, pairs)
    recall = {b: np.mean([hit[i] for i, x in enumerate(band) if x == b]) for b in BANDS}
    print(most, {b: round(float(r), 3) for b, r in recall.items()})
    assert min(recall.values()) >= least, recall


def test_near_copies_that_no_hub_of_their_bucket_is_near(spark, monkeypatch):
    """Every line falls into the one bucket; its least and greatest line are strangers to most groups."""
    from pyspark.sql import functions as F

    monkeypatch.setattr("foliant.llm.lines.table_keys", lambda kind, picked: F.array(F.lit(1)))
    monkeypatch.setattr("foliant.llm.lines.BLOCK", 16)
    monkeypatch.setattr("foliant.llm.lines.HOT", 64)
    rng = np.random.RandomState(3)
    pairs = [(line, changed(rng, line, 1)) for line in (words(rng, n) for n in (8, 12, 30, 60) for _ in range(20))]
    hub = words(rng, 20)
    groups = [*pairs, *((hub, changed(rng, hub, 1)) for _ in range(40))]
    hit = found(spark, groups)
    assert all(hit[i] for i in range(len(groups)) if groups[i][0] != groups[i][1])


@pytest.mark.parametrize("kind", KINDS)
def test_chance_of_meeting_does_not_fall_with_the_number_of_lines(kind):
    rng = np.random.RandomState(1)
    agree = rng.rand(20_000, POOL) < KINDS[kind][0]
    widths = set()
    for lines in (1_000, 10**6, 10**7, 10**8, 10**9):
        picked = tables(kind, lines)
        widths.add(len(picked[0]))
        met = np.zeros(len(agree), bool)
        for p in picked:
            met |= agree[:, p].all(1)
        assert met.mean() >= RECALL - 0.01
    assert len(widths) > 1


def test_lines_of_few_words_and_of_scripts_without_spaces(spark):
    chinese = "版权所有本网站的全部内容均受著作权法保护未经许可不得转载或以任何形式使用"
    thai = "สงวนลิขสิทธิ์ห้ามคัดลอกหรือเผยแพร่เนื้อหาส่วนหนึ่งส่วนใดโดยไม่ได้รับอนุญาต"
    kana = "このサイトのコンテンツは著作権法により保護されています無断で転載することを禁じます"
    far = "\U00020000\U00020001\U00020002\U00020003\U00020004\U00020005\U00020006\U00020007\U00020008\U00020009" * 3
    again = [chinese, thai, kana, far, "Internationalisation guidelines", "Verantwortungsbewusstsein"]
    near = [(chinese, chinese.replace("转", "换")), (kana, kana.replace("無", "不")), (chinese * 5, (chinese * 5).replace("保护", "保卫", 3))]
    short = ["one", "two words", "目录"]
    rows = [(i, a + "\n" + b) for i, (a, b) in enumerate([*((x, x) for x in again), *near])]
    got = {r.doc_id: list(r.dropped) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(1 in dropped for dropped in got.values()), got
    kept = dedup_lines(spark.createDataFrame([(1, "\n".join(short * 2))], "doc_id long, text string")).first()
    assert list(kept.dropped) == []
    third = "".join("甲乙丙丁"[i % 4] if i % 3 == 0 else c for i, c in enumerate(chinese))
    assert list(dedup_lines(spark.createDataFrame([(1, chinese + "\n" + third)], "doc_id long, text string")).first().dropped) == []


def test_keys_do_not_depend_on_the_size_of_the_input(spark, monkeypatch):
    """A near pair is found or not whatever else is in the corpus (F4)."""
    from foliant.llm import lines

    class Enough(Exception):
        pass

    asked = []

    def stop(kind, n):
        asked.append(tables(kind, n))
        raise Enough

    monkeypatch.setattr(lines, "LINES", 4)
    monkeypatch.setattr(lines, "tables", stop)
    rng = np.random.RandomState(7)
    texts = [words(rng, 20) for _ in range(30)]
    for some, more in ((texts[:2], {}), (texts, {}), (texts, {"expected": 5})):
        with pytest.raises(Enough):
            dedup_lines(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), **more)
    assert asked[0] == asked[1] != asked[2]


def test_few_tables_meet_as_often():
    """Tables that share few minima need not be so many (F1): 17 before."""
    assert len(tables("words", 1_000)) <= 14


def test_extents_refuse_no_similar_lines(spark):
    """Lengths tell most strangers before their texts are fetched (F1), and never two similar lines."""
    from pyspark.sql import functions as F

    from foliant.llm import lines as L

    rng = np.random.RandomState(5)
    pairs = [(a, changed(rng, a, rng.randint(1, 9))) for a in (words(rng, rng.randint(3, 40)) for _ in range(200))]
    pairs += [(a, b[: max(1, int(len(b) * rng.uniform(0.7, 1)))]) for a, b in pairs]
    pairs = [(" ".join(a), " ".join(b)) for a, b in pairs] + [("版 权 所 有 本 网 站", "版 权 所 有 本 网"), ("版 权 所", "a" * 130), ("x " * 60 + "y", "x " * 70 + "y")]
    frame = spark.createDataFrame(pairs, "p string, q string")
    far = lambda c: F.rlike(c, F.lit(L.FAR))
    for c, text, coded in (("p", "x", "x_words"), ("q", "y", "y_words")):
        said = L.spelt(F.col(c))
        frame = frame.withColumn(text, F.when(F.length(said) <= L.LONG_LINE, said)).withColumn(coded, L._as_letters(F.split(c, " "))).withColumn(f"{c}_size", L.extent(F.col(c), far(c)))
    got = frame.select(L.similar(0.8).alias("near"), L.fitting(F.col("p_size"), F.col("q_size"), 0.8).alias("fits")).collect()
    assert all(r.fits for r in got if r.near)
    assert any(r.near for r in got) and any(not r.fits for r in got)


def test_words_abreast_have_the_minima_of_single_words(spark):
    """Rows that are grouped are a fraction of the words, for the same signatures (F1 op5_line_dedup): one a word before."""
    from pyspark.sql import functions as F

    from foliant.llm import lines as L

    rng = np.random.RandomState(9)
    texts = [" ".join(words(rng, n)) for n in (1, 2, 3, 4, 5, 8, 9, 33, 200)]
    frame = spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "h long, size long, norm string")
    single = frame.select("h", "size", F.explode(F.split("norm", " ")).alias("norm"))
    signed = lambda f: {r.h: tuple(r) for r in L.abreast(f).groupBy("h", "size").agg(*L.minima()).collect()}
    assert L.abreast(single).count() == sum(len(x.split()) for x in texts) > 3 * L.abreast(frame).count()
    assert signed(frame) == signed(single)


def test_only_runs_of_separators_are_replaced(spark):
    """Single spaces stay, so most words cost no replacement (F1 op5_line_dedup); results are those of the plain pattern."""
    import re

    from pyspark.sql import functions as F

    from foliant.llm import lines as L

    assert not re.search(L.BETWEEN, "one two three") and re.search(L.BETWEEN, "one  two")
    rng = np.random.RandomState(10)
    texts = ["".join(rng.choice(list(" ,.-A9é\tz{"), rng.randint(0, 40))) for _ in range(400)]
    frame = spark.createDataFrame([(x,) for x in texts], "line string")
    plain = F.trim(F.regexp_replace(F.lower("line"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    assert all(r.a == r.b for r in frame.select(L.normalised(F.col("line"), F.lit(False)).alias("a"), plain.alias("b")).collect())


def test_quicker_edit_tests_judge_alike(spark):
    """Lesser distances and differing places only accept what the whole distance accepts (F1 op5_line_dedup)."""
    from pyspark.sql import functions as F

    from foliant.llm import lines as L

    rng = np.random.RandomState(11)
    pairs = [(a, "".join(c if rng.rand() > p else str(rng.choice(["", "x", "yz"])) for c in a)) for p in (0.02, 0.1, 0.2, 0.3) for a in ("".join(rng.choice(list("abcd"), rng.randint(1, 60))) for _ in range(100))]
    frame = spark.createDataFrame(pairs + [("a", "b"), ("abcd", "abcx"), ("", "")], "x string, y string").withColumn("x_words", F.lit(None).cast("string")).withColumn("y_words", F.lit(None).cast("string"))
    whole = F.levenshtein("x", "y") <= F.floor(F.greatest(F.length("x"), F.length("y")) * 0.2 + 1e-9)
    got = frame.select(whole.alias("w"), L.similar(0.8).alias("s"), L.similar(0.8, aligned=True).alias("t")).collect()
    assert all(r.w == r.s == r.t for r in got) and 0 < sum(r.w for r in got) < len(got)
