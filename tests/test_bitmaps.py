"""Bitmap postings against sets."""

import random

from pyspark.sql import functions as F

from corpuslens.operators import bitmaps as B, facets as A


def test_numbers_are_dense_and_in_order(spark):
    ids = [f"k{i * 7919 % 1000:04d}" for i in range(1000)]
    got = B.record_numbers(spark.createDataFrame([(i,) for i in ids + ids[:5] + [None]], "id string").repartition(7)).collect()
    assert sorted((r.number, r.id) for r in got) == list(enumerate(sorted(ids)))
    assert B.record_numbers(spark.createDataFrame([], "id string")).count() == 0


def test_search_over_several_blocks(spark):
    rng = random.Random(3)
    # tags of 70 000 records: three blocks, one tag on nearly all of them, one on the borders of blocks
    borders = {0, B.BITS - 1, B.BITS, 2 * B.BITS - 1, 2 * B.BITS, 69_999}
    rows = [(i, "hot" if i % 3 else None, ["edge"] if i in borders else (["rare"] if rng.random() < 0.001 else ["a", "a"]),
             float(i % 90)) for i in range(70_000)]
    records = spark.createDataFrame(rows, "id long, grade string, tags array<string>, total_score double")
    postings = A.facet_postings(records, {"grade": "grade", "tag": "tags"})
    bitmaps, numbers = B.write_bitmaps(postings.unionByName(postings.filter("term = 'rare'")), records)
    counted = {(r.facet, r.term): r.n for r in B.counts(bitmaps).collect()}
    assert counted == {(r.facet, r.term): r.n for r in A.facet_counts(postings).collect()}
    assert counted["tag", "edge"] == len(borders)

    def brute(grade, tags):
        return sorted(i for i, g, t, _ in rows if (grade is None or g == grade) and (tags is None or set(tags) & set(t)))

    for grade, tags in (("hot", ["edge"]), ("hot", ["rare", "edge"]), (None, ["rare"]), ("hot", ["none"]), ("hot", None)):
        wanted = {f: ts for f, ts in (("grade", grade and [grade]), ("tag", tags)) if ts}
        found = B.matching(bitmaps, wanted)
        want = brute(grade, tags)
        assert sorted(r.id for r in B.keys_of(found, numbers).collect()) == want
        assert B.how_many(found).first().n == len(want)
        got = B.search(bitmaps, numbers, records, grade=grade, tags=tags, min_total=30)
        assert sorted(r.id for r in got.select("id").collect()) == [i for i in want if i % 90 >= 30]
    assert B.search(bitmaps, numbers, records).count() == len(rows)
    assert B.how_many(B.matching(bitmaps.limit(0), {"tag": ["a"]})).first().n == 0


def test_no_records(spark):
    records = spark.createDataFrame([], "id long, grade string, tags array<string>")
    bitmaps, numbers = B.write_bitmaps(A.facet_postings(records, {"grade": "grade", "tag": "tags"}), records)
    assert B.counts(bitmaps).count() == 0
    assert B.keys_of(B.matching(bitmaps, {"tag": ["a"]}), numbers).count() == 0
