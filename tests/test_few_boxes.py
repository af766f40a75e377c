"""Pictures of few boxes are folded whole, crowded ones by islands, with one result."""

import random

from veilspan.operators import boxes as bx


def rows(spark):
    rng = random.Random(4)
    made = [(g, "K", k, rng.randint(0, 300), rng.randint(0, 2000), rng.randint(1, 40), rng.randint(1, 40), rng.random()) for g in range(6) for k in range(60)]
    return spark.createDataFrame(made, "image_id int, kind string, ord int, x int, y int, w int, h int, score double")


def test_islands_only_where_pictures_are_crowded(spark, monkeypatch):
    by_islands, calls = bx._islands, []
    monkeypatch.setattr(bx, "_islands", lambda *a: calls.append(1) or by_islands(*a))
    whole = sorted(map(tuple, bx.best_boxes(rows(spark)).collect()))
    assert not calls
    monkeypatch.setattr(bx, "CROWDED", 59)
    assert sorted(map(tuple, bx.best_boxes(rows(spark)).collect())) == whole and calls
