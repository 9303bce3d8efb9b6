"""The tile grid as a table function, for SQL users: SELECT * FROM tile_grid(w, h, tile, overlap)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class TileGridRows:
    """Rows (row, col, x, y, width, height) of a grid over a w x h box; the same rule as operators.grid.tile_grid."""

    def eval(self, w: int, h: int, tile: int, overlap: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        step = tile - 2 * overlap
        if step <= 0:
            raise ValueError(f"overlap {overlap} leaves no step in tiles of {tile}")
        rows, cols = (max(1, -(-(extent - 2 * overlap) // step)) for extent in (h, w))
        for row in range(rows):
            y = max(0, row * step - overlap)
            for col in range(cols):
                x = max(0, col * step - overlap)
                yield row, col, x, y, min(tile, w - x), min(tile, h - y)


def register(spark: SparkSession) -> None:
    spark.udtf.register("tile_grid", udtf(TileGridRows, returnType="row int, col int, x int, y int, width int, height int"))
