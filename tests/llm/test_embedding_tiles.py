"""Cells of embeddings in tiles: rows at home on the left, all rows on the right."""

from collections import Counter

from repalign.llm import embeddings


def test_rows_at_home_meet_every_other_row_of_their_cell_once(spark):
    rows = [(k, 1, 4, b, 0, 0, (k + b) % 5 == 0) for b in range(2) for k in range(40 if b else 3)]
    cells = spark.createDataFrame(rows, "key long, label long, dim int, block int, x int, y int, home boolean")
    got = embeddings._spread(cells, 6).collect()
    for b, n in ((0, 3), (1, 40)):
        tiles = {}
        for r in got:
            if r.block == b:
                tiles.setdefault((r.tile_i, r.tile_j), []).append(r)
        met = Counter((x.key, y.key) for t in tiles.values() for x in t if x.left for y in t if y.right)
        home = [r[0] for r in rows if r[3] == b and r[6]]
        assert met == Counter((x, y) for x in home for y in range(n))
    # 40 rows in seven right parts, eight of them at home in two left parts: 32 rows go to two tiles, eight to seven and one more
    assert sum(r.block == 1 for r in got) == 32 * 2 + 8 * 8
    assert all(r.left or r.right for r in got)
