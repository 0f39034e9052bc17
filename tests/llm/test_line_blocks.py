"""Line dedup: every block that an earlier document holds finds a partner, however frequent its lines are."""

import random
from collections import Counter

from helpers import docs
from test_line_dedup import corpus

from quire.llm.line_dedup import MIN_CHARS, align, blocks, without_common_blocks


def line(rng, n=40):
    return "".join(rng.choices("abcdefgh ", k=n - 1)) + "."


def removed(spark, texts):
    return {r.doc_id: (r.text, r.n_removed) for r in without_common_blocks(docs(spark, texts)).collect()}


def test_frequent_passage_beside_a_rare_line(spark):
    rng = random.Random(1)
    passage = [line(rng) for _ in range(5)]
    texts = ["\n".join([line(rng), *passage, line(rng)]) for _ in range(40)]
    rare = line(rng)  # held by two documents only, while forty hold the passage
    texts[20] += "\n" + rare
    texts[30] += "\n" + rare
    got = removed(spark, texts)
    assert got[0][1] == 0 and all(got[d][1] == 5 for d in range(1, 40))
    assert not any(x in got[30][0] for x in passage) and rare in got[30][0]
    blank = removed(spark, ["\n".join([line(rng), *[""] * 200, line(rng)]) for _ in range(3)])
    assert all(n == 0 for _, n in blank.values())


def test_block_whose_lines_are_held_apart_before(spark):
    rng = random.Random(2)
    one, two = line(rng, 60), line(rng, 60)
    texts = ["\n".join([line(rng), one, line(rng)]), "\n".join([line(rng), two, line(rng)])]
    texts += ["\n".join([line(rng), one, two, line(rng)]) for _ in range(2)]
    got = removed(spark, texts)
    assert [got[d][1] for d in range(4)] == [0, 0, 0, 2]


def test_like_all_earlier_documents(spark):
    texts = corpus()
    lines = [(t or "").split("\n") for t in texts]
    count = Counter(x for ls in lines for x in set(ls))
    own = [[(p, x, len(x)) for p, x in enumerate(ls) if count[x] > 1] for ls in lines]
    got = removed(spark, texts)
    for d, ls in enumerate(lines):
        gone = {p for a in range(d) for first, last in blocks(own[a], own[d], MIN_CHARS) for p in range(first, last + 1)}
        assert got[d] == ("\n".join(x for p, x in enumerate(ls) if p not in gone), len(gone))


def test_repeated_passages_are_aligned(spark):
    assert align([1, 2, 8, 1, 2], [9, 1, 2, 7]) == [(3, 1), (4, 2)]
    assert align([8, 1, 2, 3, 7, 1, 2, 3, 6], [5, 1, 2, 3, 4, 1, 2, 3, 9]) == [(1, 1), (2, 2), (3, 3), (5, 5), (6, 6), (7, 7)]
    assert align([1, 2, 6, 1, 2, 3, 4, 7, 3, 4, 5], [9, 1, 2, 3, 4, 8]) == [(3, 1), (4, 2), (5, 3), (6, 4)]
    assert align([1, 2] * 20_000, [2, 2, 1, 1] * 10_000)  # no anchors anywhere, and yet soon done
    rng = random.Random(3)
    passage = [line(rng) for _ in range(4)]
    twice = ["\n".join([line(rng), *passage, line(rng), *passage, line(rng)]) for _ in range(2)]
    got = removed(spark, [*twice, "\n".join([line(rng), *passage, line(rng)])])
    assert [got[d][1] for d in range(3)] == [0, 8, 4]
