"""References to images, and the geometry of image tools. Their pixels are in pixels.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MOST_BYTES = 20 * 1024 * 1024
URI = r"(?i)^(?:https?://|file://|artifact://|data:)"
#: Words in which a model names an image, the qualities that mean the last one, and the nouns of a rollout's input.
ARTICLES = ["the", "a", "an"]
QUALITIES = ["uploaded", "input", "original", "source", "current", "latest", "cropped", "enhanced"]
LAST_QUALITIES = ["latest", "cropped", "enhanced"]
NOUNS = ["img", "image", "photo", "picture"]
INPUT_NOUNS = ["inputimage", "image", "img"]
#: What a degraded image is restored with.
RESTORE = {"blur": "sharpen", "downsample": "super_resolution", "rotate": "perspective_correct"}


def scheme(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def _names(uri: Column, natural: bool) -> Column:
    """What an image may be called by its address: all of it, its file's name, and that without the last suffix."""
    path = F.regexp_replace(F.lower(uri), r"[?#].*$", "") if natural else F.lower(uri)
    base = F.element_at(F.split(path, "/"), -1)
    return F.array(F.lower(uri), base, F.regexp_replace(base, r"\.[^.]+$", ""))


def _called(value: Column, natural: bool) -> tuple[Column, Column]:
    """(number, quality) of a reference by common words: number is null if it isn't one, and '' if it has no number. A suffix, an article and a quality are taken off one after the other; what is left must be a noun and a number."""
    left = F.regexp_replace(value, r"\.[A-Za-z0-9]+$", "")
    quality = F.lit("")
    if natural:
        left = F.regexp_replace(left, f"(?i)^(?:{'|'.join(ARTICLES)})\\s+", "")
        first = F.element_at(F.split(left, r"\s+", 2), 1)
        has = F.lower(first).isin(QUALITIES) & (F.length(first) < F.length(left))
        quality = F.when(has, first).otherwise("")
        left = F.when(has, F.element_at(F.split(left, r"\s+", 2), 2)).otherwise(left)
    else:
        left = F.when(left.startswith("input"), F.concat(F.lit("input"), F.regexp_replace(F.substring(left, F.lit(6), F.length(left)), "^[_ -]", ""))).otherwise(left)
    noun = F.regexp_extract(left, "^[A-Za-z]+", 0)
    tail = F.substring(left, F.length(noun) + 1, F.length(left))
    digits = F.regexp_replace(tail, r"^[_\s-]" if natural else "^[_ -]", "")
    fits = F.lower(noun).isin(NOUNS if natural else INPUT_NOUNS)
    return F.when(fits & (tail == ""), "").when(fits & digits.rlike("^[0-9]+$"), digits), quality


def resolve(reference: Column, images: Column, natural: bool = False, ids: Column | None = None) -> Column:
    """(uri, error) of an image reference against the images of a run.

    An address stands for itself; then an image's address, file name or stem; then img_N, from 1 (0 is the first, too);
    then the only image. natural also knows an image's id (ids, beside images), and 'latest', 'cropped' and 'enhanced'
    in this spelling as the last image, and leaves what it can't resolve as it is; otherwise 'sandbox:' is the first
    image and an ambiguous name is an error. A null reference is null, without an error if natural.
    """
    bare = T.strip(reference) if natural else reference
    low = F.lower(T.strip(reference))
    n = F.coalesce(F.size(images), F.lit(0))
    named = F.transform(images, lambda u, i: F.struct(u.alias("uri"), F.array_contains(_names(u, natural), low).alias("hit"), i.alias("i")))
    if ids is not None:
        named = F.transform(named, lambda x: F.struct(x["uri"].alias("uri"), (x["hit"] | F.coalesce(F.lower(F.get(ids, x["i"])) == low, F.lit(False))).alias("hit"), x["i"].alias("i")))
    exact = F.get(F.filter(named, lambda x: x["hit"]), F.lit(0))["uri"]
    word, quality = _called(bare if natural else low, natural)
    number = word.try_cast("int")
    numbered = F.when(number.isNotNull(), F.get(images, F.greatest(number - 1, F.lit(0))))
    out = F.when(bare.rlike(URI if natural else URI.replace("(?i)", "")), bare)
    if not natural:
        out = out.when(low.startswith("sandbox:"), F.get(images, F.lit(0)))
    out = out.when(exact.isNotNull(), exact).when(numbered.isNotNull(), numbered)
    if natural:
        out = out.when(word.isNotNull() & quality.isin(LAST_QUALITIES) & (n > 0), F.element_at(images, -1))
    out = out.when((n == 1) & (low != ""), F.get(images, F.lit(0))) if natural else out.when(n == 1, F.get(images, F.lit(0)))
    if natural:
        return F.struct(out.otherwise(F.when(low == "", reference).otherwise(bare)).alias("uri"), F.lit(None).cast("string").alias("error"))
    error = F.when(out.isNull(), F.when(n == 0, "no image to resolve").otherwise("ambiguous image reference"))
    return F.struct(out.alias("uri"), error.alias("error"))


def data_uri(content: Column, mime: Column) -> Column:
    """Bytes as a data URI."""
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("image/png")), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def data_bytes(uri: Column) -> Column:
    """The bytes of a base64 data URI; null for anything else, and for broken base64."""
    return F.when(uri.rlike(r"(?is)^data:[^,]*;base64,"), F.try_to_binary(F.regexp_extract(uri, r"(?s)^[^,]*,(.*)$", 1), F.lit("base64")))


def crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """(left, top, right, bottom, error) of a rectangle clipped to an image; its size counts from the clipped corner."""
    left, top = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    right, bottom = F.least(left + w, width), F.least(top + h, height)
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"), F.when((right <= left) | (bottom <= top), "empty crop").alias("error"))


def sharpen_strength(c: Column) -> Column:
    return T.clamp(c, 0.0, 5.0)


def upscale(w: Column, h: Column, scale: Column) -> Column:
    """(width, height) after scaling by 1.1 to 4, 2 by default."""
    s = T.clamp(F.coalesce(scale, F.lit(2.0)), 1.1, 4.0)
    return F.struct(F.bround(w * s).cast("bigint").alias("width"), F.bround(h * s).cast("bigint").alias("height"))


def rotation(angle: Column) -> Column:
    return T.clamp(F.coalesce(angle, F.lit(0.0)), -20.0, 20.0)


def restoration(op: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RESTORE.items() for x in kv]), op)


def candidates(images: DataFrame, key: str, order: str, limit: int = 8, side: int = 512) -> DataFrame:
    """Images of a picture type and at least side pixels each way, the first limit of each key."""
    ok = images.where(F.col("mime").startswith("image/") & (F.col("width") >= side) & (F.col("height") >= side))
    return ok.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= limit).drop("_r")


def within_limit(size: Column, most: int = MOST_BYTES) -> Column:
    return F.coalesce(size <= most, F.lit(False))


def reading_order(blocks: DataFrame, key: str, box: str = "box") -> DataFrame:
    """blocks with reading_order from 0: by the least y of a block's corners, then the least x; box is an array of (x, y) pairs."""
    y, x = F.array_min(F.transform(box, lambda p: p[1])), F.array_min(F.transform(box, lambda p: p[0]))
    return blocks.withColumn("_y", y).withColumn("_x", x).withColumn("reading_order", (F.row_number().over(Window.partitionBy(key).orderBy("_y", "_x")) - 1).cast("bigint")).drop("_y", "_x")


def list_error(images: Column) -> Column:
    """What is wrong with a list of image addresses, null if nothing is: empty, an empty one, or one that only a running agent can read."""
    return (
        F.when(F.coalesce(F.size(images), F.lit(0)) <= 0, "images must be a non-empty list")
        .when(F.exists(images, lambda u: F.coalesce(u, F.lit("")) == ""), "an image must be a path or address")
        .when(F.exists(images, lambda u: u.startswith("artifact://")), "contains a runtime-only artifact URI")
    )
