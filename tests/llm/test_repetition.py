import numpy as np

from stratagraph.llm import repetition


def plain(words):
    n, longest = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    return longest


def test_longest_repeats_against_brute_force():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, k, n) for k, n in ((2, 40), (3, 60), (50, 80), (1, 30), (5, 0), (9, 1))]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    _, _, longest = repetition.repeats(np.concatenate(texts), doc)
    assert longest.tolist() == [x for t in texts for x in plain(t.tolist())]


def test_counts(spark):
    line = "one two three four five six seven eight nine ten eleven"
    texts = [None, "", " \n\t", line + "\n" + line, "a#b $c\u00a0d\n\nx", "w " * 60, " ".join(map(str, range(60)))]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, line, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stats int")
    out = repetition.with_repetition(df)
    failed, kept = repetition.verdict()
    got = {r.doc_id: r for r in out.select("doc_id", "stats.*", failed.alias("failed"), kept.alias("kept")).collect()}
    assert [got[i].n_words for i in range(7)] == [0, 0, 0, 22, 3, 60, 60]
    assert (got[3].n_dup_lines, got[3].n_repeat_words, got[3].covered_words, got[3].longest_repeat) == (1, 22, 22, 11)
    assert (got[4].n_symbols, got[4].word_chars, got[4].n_dup_lines) == (2, 8, 0)
    assert (got[5].failed, got[5].kept, got[6].failed, got[6].kept) == (True, False, False, True)
    assert got[5].longest_repeat == 59
    assert len(got) == 8 and out.where("false").count() == 0
    assert repetition.with_repetition(df.where("false")).count() == 0
