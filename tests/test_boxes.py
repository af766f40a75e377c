"""Folding of boxes against a plain search of all boxes before; time of one crowded picture."""

import random
import time

from veilspan.operators.boxes import _better, _grown, _iou, _touch, best_boxes, fold_boxes, merge_boxes


def brute(boxes, same, join):
    kept = []
    for b in boxes:
        at = next((k for k, o in enumerate(kept) if same(o, b)), None)
        if at is None:
            kept.append(b)
        else:
            kept[at] = join(kept[at], b)
    return kept


def scattered(rng, n, size):
    return [(rng.uniform(-size, size), rng.uniform(0, size), *((rng.uniform(0, 900), rng.uniform(0, 900)) if rng.random() < 0.02 else (rng.choice([0, 5, 12, 30]), rng.choice([0, 8, 12]))),
             rng.choice([0.1, 0.5, 0.9, None]), rng.choice(["", "a", "b c", None])) for _ in range(n)]


def test_grid_finds_what_a_search_of_all_finds():
    rng = random.Random(9)
    for n, size in ((1, 10), (30, 50), (300, 400), (300, 3000)):
        for _ in range(12):
            boxes = scattered(rng, n, size)
            for same, join in ((_touch, _grown), (lambda a, b: _iou(a, b) > 0.3, _better), (lambda a, b: _iou(a, b) > 0, _better)):
                assert fold_boxes(boxes, same, join) == brute(boxes, same, join)
    assert fold_boxes([], _touch, _grown) == []


def test_time_is_near_linear():
    rng = random.Random(2)

    def seconds(n):
        boxes = [(x, y, 10.0, 10.0, rng.random(), "") for x, y in ((rng.uniform(0, 8 * n ** 0.5), rng.uniform(0, 8 * n ** 0.5)) for _ in range(n))]
        start = time.process_time()
        fold_boxes(boxes, lambda a, b: _iou(a, b) > 0.3, _better)
        return time.process_time() - start

    small, large = seconds(10_000), seconds(100_000)
    assert large < 25 * small and large < 60


def test_tables(spark):
    rows = [(1, "T", "x", 0, 0, 10, 10, "b"), (1, "T", "x", 10, 0, 5, 10, "a"), (1, "T", "x", 40, 0, 5, 10, "c"), (1, "U", "x", 3, 3, 5, 5, "d"), (2, None, "x", 0, 0, 1, 1, None)]
    boxes = spark.createDataFrame(rows, "image_id int, kind string, effect string, x int, y int, w int, h int, label string")
    got = sorted((r.image_id, r.kind or "", r.x, r.w, r.label or "") for r in merge_boxes(boxes).collect())
    assert got == [(1, "T", 0.0, 15.0, "b a"), (1, "T", 40.0, 5.0, "c"), (1, "U", 3.0, 5.0, "d"), (2, "", 0.0, 1.0, "")]
    faces = spark.createDataFrame([(1, "F", k, 20 * k, 0, 60, 50, float(s)) for k, s in ((0, 1), (1, 3), (2, 2), (3, 9))], "image_id int, kind string, ord int, x int, y int, w int, h int, score double")
    assert sorted((r.x, r.score) for r in best_boxes(faces).collect()) == [(20.0, 3.0), (60.0, 9.0)]
    assert merge_boxes(boxes.limit(0)).count() == 0
