"""Predicates and listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as X

# Header cells and noise that are no material or supplier.
HEADER_CELLS = ("supplier", "nameofmaterial(korean)", "nameofmaterial(english)", "nameofmaterial", "halalby",
                "1차", "2차", "3차", "4차", "원료명", "영문명")
NOISE_CELLS = ("email", "e-mail", "mail", "메일", "주소", "담당", "contact", "supplier", "업체", "비고", "remark")

# Attachments that can be scanned, and names of decoration images.
SCAN_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")
SMALL_IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp")
DECORATION_NAMES = ("image001", "image002", "image003", "logo", "signature", "sign", "banner", "footer", "header",
                    "facebook", "instagram", "naver", "kakao")

# Signs of a delivery failure notice.
BOUNCE_SIGNS = ("mailer-daemon", "mail delivery subsystem", "postmaster", "daemon@", "delivery status notification",
                "undelivered mail", "returned mail", "failure notice", "mail delivery failed", "delivery failure",
                "message not delivered", "undeliverable", "delivery incomplete", "배달 실패", "전송 실패", "반송", "메일 배달", "전달 실패")


def valid_material(name: Column, blocked: Sequence[str] = HEADER_CELLS, block_part: str = "nameofmaterial") -> Column:
    key = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit(""))
    return ~X.is_missing(name) & ~key.isin(*blocked) & ~key.contains(block_part)


def cell_noise(cell: Column, noise: Sequence[str] = NOISE_CELLS) -> Column:
    """Header word, e-mail address or single character."""
    text = F.lower(X.squash(F.coalesce(cell, F.lit(""))))
    return (F.length(text) <= 1) | text.isin(*noise) | text.rlike(X.EMAIL)


def scannable(name: Column, size: Column) -> Column:
    ext = X.file_ext(name)
    named = ~F.lower(name).rlike("|".join(DECORATION_NAMES))
    tiny = ext.isin(*SMALL_IMAGE_EXTENSIONS) & (size > 0) & (size < 20000)
    return ext.isin(*SCAN_EXTENSIONS) & named & ~tiny


def bounced(*texts: Column, signs: Sequence[str] = BOUNCE_SIGNS) -> Column:
    return F.lower(F.concat_ws(" ", *texts)).rlike("|".join(signs))


def search_levels(long: DataFrame, keyword: str, key: str, depth: str, fields: Sequence[str], limit: int) -> DataFrame:
    """Keyword search over all levels of a material; the shallowest hit is reported.

    An empty keyword lists the main level. The filter runs before the reduction, and the
    reduction combines map-side."""
    if keyword:
        hit = F.lower(F.concat_ws(" ", *fields)).contains(keyword.lower())
    else:
        hit = F.col(depth) == 0
    best = long.filter(hit).groupBy(key).agg(F.min_by(F.struct(depth, *fields), depth).alias("hit"))
    return best.select(key, "hit.*").orderBy(key).limit(limit)


def listing(df: DataFrame, equals: Mapping[str, object], order: Sequence[Column], limit: int) -> DataFrame:
    """Newest-first listing: optional equality filters, then a top-k plan.

    All filters run before the limit, so a page is never short while rows remain."""
    for col, value in equals.items():
        if value is not None:
            df = df.filter(F.col(col) == F.lit(value))
    return df.orderBy(*order).limit(max(1, limit))


def not_yet_sent(requests: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests without a successful send in the same mode."""
    done = log.filter("success").select(*keys)
    return requests.join(done, list(keys), "left_anti")


def per_class_sample(df: DataFrame, classes: Sequence[str], cls: str, ident: str, n: int, seed: str) -> DataFrame:
    """``n`` rows per class in the order of a salted hash: the same rows every run."""
    from pyspark.sql import Window as W

    order = W.partitionBy(cls).orderBy("_h", ident)
    return (
        df.filter(F.col(cls).isin(*classes))
        .withColumn("_h", F.md5(F.concat(F.col(ident).cast("string"), F.lit(seed))))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= n)
        .drop("_h", "_n")
    )


def lookup(keys: DataFrame, rows: DataFrame, on: Sequence[str], name: str, deepest: int = 4) -> DataFrame:
    """Point lookup that reports its outcome in ``status`` instead of raising."""
    found = keys.join(rows.withColumn("_found", F.lit(True)), list(on), "left")
    status = (
        F.when((F.col(on[0]) < 0) | ~F.col(on[1]).between(0, deepest), F.lit("OUT_OF_RANGE"))
        .when(F.col("_found").isNull(), F.lit("NOT_FOUND"))
        .when(X.is_missing(F.col(name)), F.lit("NO_NAME"))
        .otherwise(F.lit("OK"))
    )
    return found.withColumn("status", status).drop("_found")
