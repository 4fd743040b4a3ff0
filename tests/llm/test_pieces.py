import random

import pytest

from seqloom.llm.pieces import bisect, find_gaps, split_items


def check(text, pieces, limit, overlap, gap_min):
    pieces = sorted(pieces, key=lambda p: p.piece_no)
    assert [p.piece_no for p in pieces] == list(range(len(pieces)))
    assert all(len(p.piece) == p.end_pos - p.start_pos <= limit and p.piece == text[p.start_pos : p.end_pos] for p in pieces)
    assert pieces[0].start_pos == 0 and pieces[-1].end_pos == len(text)
    back = pieces[0].piece
    for a, b in zip(pieces, pieces[1:]):
        assert b.start_pos == a.end_pos - overlap and b.overlap == overlap and a.piece[len(a.piece) - overlap :] == b.piece[:overlap]
        back += b.piece[overlap:]
        if b.at_gap:
            assert text[b.start_pos + overlap - gap_min // 2 : b.start_pos + overlap + gap_min // 2] == "N" * (gap_min // 2 * 2)
    assert back == text


def test_round_trip(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ACGT") if rnd.random() < 0.97 else "N" * rnd.randint(1, 30) for _ in range(n)) for n in (0, 40, 60, 61, 500, 3000, 20000)] + ["N" * 700, "A" * 5000]
    raw = [(i, t, f"1 {t[:30]}\r\n 31 {t[30:].lower()}", 0, "") for i, t in enumerate(texts)] + [(None, None, "a" * 61, 0, ""), (98, None, None, 0, ""), (99, None, "-" * 900, 0, "")]
    df = spark.createDataFrame(raw, "id long, t string, s string, piece_no int, text string")
    got = split_items(df, "id", "s", limit=60, overlap=8, gap_min=10).collect()
    for i, t in enumerate(texts):
        mine = [r for r in got if r.item_id == i]
        assert bool(mine) is (len(t) > 60)
        if mine:
            check(t, mine, 60, 8, 10)
    assert len([r for r in got if r.item_id is None]) == 2 and not [r for r in got if r.item_id in (98, 99)]
    assert split_items(df.limit(0), "id", "s", limit=60, overlap=8, gap_min=10).count() == 0


def test_gaps_first():
    text = b"A" * 55 + b"N" * 12 + b"A" * 40 + b"N" * 30 + b"A" * 60
    gaps = find_gaps(text, 10)
    assert bisect(len(text), gaps, 150, 10) == [(122, True)]  # the longer of two in the middle half
    assert bisect(200, (gaps[0][:0], gaps[1][:0]), 120, 10) == [(100, False)]
    assert find_gaps(b"NNNNNNNNN", 10)[0].size == 0


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        split_items(spark.range(1).selectExpr("id", "'A' s"), "id", "s", limit=10, overlap=6, gap_min=3)
