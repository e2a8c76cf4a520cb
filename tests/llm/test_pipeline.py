"""The pipeline's stages against brute force, each on its own input."""

import random

import pytest

import corpus_pipeline as P
from orrery.llm.decontaminate import overlap, question_and_answer, runs, runs_of_all_sizes, words
from orrery.llm.queries import tokenizer_file
from tests.llm.test_ngram_join import by_hand
from tests.llm.test_operators import check_packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/out"
        f(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in P.STAGES] == ["language", "near_copies", "benchmark", "packed"]
    for docs, result in stages[:-1]:
        assert result.columns == docs.columns


def test_language_keeps_what_is_language(stages):
    docs, kept = stages[0]
    letters = docs.where(r"text rlike '\\p{L}'").count()
    assert 0.998 * letters <= kept.count() <= letters


def test_language_rejects_what_is_none(spark):
    """Foreign scripts, digests, key mashing and letterless texts go; short and clean texts of all languages stay."""
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mash = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    none = [
        "привет как дела у вас сегодня хорошая погода на улице и в доме тоже всё спокойно",
        "Η γλώσσα αυτή δεν υπάρχει πουθενά στα κείμενα που διαβάστηκαν ως τώρα εδώ",
        "これは学習されていない言語の文章です。どこにも例がありませんでした。今日は天気がいい",
        "这是一段没有学习过的语言的文字没有任何例子今天天气很好我们出去走走吧",
        "هذه لغة لم يتعلمها النموذج من قبل ولا توجد أمثلة عليها في النصوص",
        mash("qwxzjkvbp", 30), mash("asdfghjkl", 40), mash("0123456789abcdef", 60), mash("qxjzkvwy", 200), "12 34 -- !!",
    ]
    clean = ["This.", "Von.", "The ing of thering and onthe", "Der die und einheit ist von", "Ces eux ouan de la"]
    added = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(none + clean)], docs.schema)
    left = {r["doc_id"] - 10**6 for r in P.language(spark, docs.unionByName(added), SF).where("doc_id >= 1000000").collect()}
    assert left == set(range(len(none), len(none) + len(clean)))


def test_one_of_each_group_stays(stages):
    docs, kept = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {d for d, _, c in by_hand(rows, 80, 5) if d == c}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.count() == len(want) < len(rows)


def test_texts_with_items_go(spark, stages):
    docs, kept = stages[2]
    items = [[runs(p) for p in question_and_answer(r["text"])] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}
    assert gone
    for r in docs.collect():
        held = runs_of_all_sizes(words(r["text"]))
        inside = any(all(overlap(p, held) == 1 for p in parts) for parts in items)
        near = any(all(overlap(p, held) >= 0.6 for p in parts) for parts in items)
        assert (inside <= (r["doc_id"] in gone)) and ((r["doc_id"] in gone) <= near)


def test_packed(stages):
    from tokenizers import Tokenizer

    docs, pieces = stages[3]
    check_packing(pieces.collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), 2048)


def test_run_equals_stages(spark, stages):
    a, b = P.run(spark, SF), stages[-1][1]
    assert sorted(a.select("doc_id", "piece", "ids_crc32").collect()) == sorted(b.select("doc_id", "piece", "ids_crc32").collect())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "le chat est dans la maison avec nous tous"), (None, "le chat est dans la maison avec nous tous"), (3, "le chat est dans la maison avec nous tous"), (4, "12 !!"), (4, "other words of a longer kind are here now")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for first in (docs, docs.limit(0), docs.withColumn("score", docs["doc_id"]).withColumn("row", docs["doc_id"])):
        df = first
        for name, f in P.STAGES[:-1]:
            df = f(spark, df, SF)
            assert df.columns == first.columns
        assert df.count() == (2 if first.count() else 0)
        assert P.STAGES[-1][1](spark, df, SF).count() == df.count()
