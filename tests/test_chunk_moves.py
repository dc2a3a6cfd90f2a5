"""What chunking moves: texts once, no words."""

from lossgrid.operators import retrieval


def test_words_are_made_after_the_text_has_moved(spark):
    rows = [("a", p, f"w{p} " * 30) for p in range(5)] + [("b", 1, "x " * 90), (None, 1, "y " * 10), ("c", 1, None), ("d", 1, " ")]
    chunks = retrieval.chunk_pages(spark.createDataFrame(rows, "source string, page_num int, text string"), 40, 5)
    lines = chunks._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = lines[next(i for i, x in enumerate(lines) if "Window [" in x) :]
    assert not any("split(" in x for x in below[: next(i for i, x in enumerate(below) if "LocalRelation" in x or "LogicalRDD" in x)])
    got = {(r.source, r.chunk_index): (r.page_start, r.page_end, r.word_count, r.text) for r in chunks.collect()}
    want = {}
    for source, words in (("a", [(p, f"w{p}") for p in range(5) for _ in range(30)]), ("b", [(1, "x")] * 90), (None, [(1, "y")] * 10)):
        for k, at in enumerate(range(0, max(1, len(words) - 40 + 35), 35)):
            part = words[at : at + 40]
            want[source, k] = (part[0][0], part[-1][0], len(part), " ".join(w for _, w in part))
    assert got == want
