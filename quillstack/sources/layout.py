"""Where an index keeps its pages: directories of tiles, titles and sizes of articles, vectors' lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A page's share of dark pixels under which its crop is blank; vectors of a list, and lists at most.
LEAST_INK, LIST_ROWS, MOST_LISTS = 0.005, 40, 4096


def article_of(path: Column) -> Column:
    """12 of .../12.png.tiles; -1 of a directory that has no number."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.split_part(name, F.lit("."), F.lit(1)).try_cast("int"), F.lit(-1))


def tile_listing(paths: DataFrame, path: str = "path") -> DataFrame:
    """`paths` with article_id: to be ordered by number, so 10 is not between 1 and 2."""
    return paths.where(F.col(path).endswith(".png.tiles")).withColumn("article_id", article_of(F.col(path)))


def page_image(article: Column, tile: Column) -> Column:
    return F.format_string("tiles/%d.png.tiles/tile_%04d.jpg", article.cast("long"), tile.cast("long"))


def with_titles(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """`rows` (article_id, ..) with the title of (article_id, title), `?` where there is none."""
    return rows.join(articles.select("article_id", "title"), "article_id", "left").withColumn("title", F.coalesce("title", F.lit("?")))


def source_pdf(url: Column) -> Column:
    """The article's source, if it is a PDF; null otherwise."""
    path = F.replace(url, F.lit("\\"), F.lit("/"))
    return F.when(F.lower(path).endswith(".pdf"), path)


def existing(rows: DataFrame, files: DataFrame, path: str = "pdf") -> DataFrame:
    """`rows` with their source set to null where it is none of `files` (path): a source that is gone has no text."""
    there = files.select(F.col("path").alias("__there")).distinct()
    return rows.join(there, F.col(path) == F.col("__there"), "left").withColumn(path, F.col("__there")).drop("__there")


def with_sizes(rows: DataFrame, images: DataFrame) -> DataFrame:
    """`rows` (article_id, tile, ..) with the size of (article_id, tile, page_width, page_height); 0 by 0 where it isn't known."""
    return rows.join(images, ["article_id", "tile"], "left").na.fill(0, ["page_width", "page_height"])


def image_fit_key(path: Column, modified: Column, size: Column, policy: Column, floor: float = 0.85, quality: int = 90) -> Column:
    """What names a fitted image: its file, and all that changes what the fit makes of it."""
    parts = [path, modified.cast("string"), size.cast("string"), policy, F.lit(str(floor)), F.lit(str(quality))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def fit_policy(name: str, kind: str, long_edge: int = 0, chase_tiles: bool = False) -> str:
    return f"{name}|{kind}|{long_edge}|{int(chase_tiles)}"


def without_blanks(crops: DataFrame, ink: str = "ink") -> DataFrame:
    """Crops of which the share of dark pixels (grey under 200) isn't too small; unknown shares stay."""
    return crops.where(F.coalesce(F.col(ink), F.lit(1.0)) >= LEAST_INK)


def index_plan(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by.., vectors, lists): how many lists an index of so many vectors has."""
    n = vectors.groupBy(*by).agg(F.count("*").alias("vectors"))
    return n.withColumn("lists", F.least(F.lit(MOST_LISTS), F.greatest(F.lit(1), F.floor(F.col("vectors") / LIST_ROWS))).cast("long"))
