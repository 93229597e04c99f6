"""Text enrichment: the port of a remote model, its stand-in, cache keys and waits; translation.py has the run."""

from __future__ import annotations

from typing import Protocol
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed sentences that the stand-in for a remote model deals out, and the white space it trims.
SENTENCES = (
    "实验结果表明，该方法在标准数据集上取得了优于基线的性能。",
    "我们在本节中分析该现象背后的原因，并给出两种可能的解释。",
    "为了验证这一假设，我们在多个规模上重复了实验，结论保持一致。",
    "与已有工作相比，本文的主要贡献在于在简化结构的同时保持精度。",
    "值得注意的是，当网络深度继续增加时，训练误差反而出现上升。",
    "这种退化现象并非由过拟合引起，而是优化难度随深度增加所致。",
    "我们在下文中给出该问题的形式化描述，并讨论它与相关工作的区别。",
    "上述结论在图像分类与目标检测两个任务上均得到了验证。",
    "该设计的一个直接好处是参数量与计算量的增长都落在可接受范围内。",
    "我们把这一改进归因于梯度传播路径的缩短，后续实验也支持这一判断。",
    "需要说明的是，本文的方法并不依赖特定的网络结构，具有较好的通用性。",
    "综合来看，该方案在精度、速度与实现复杂度三者之间取得了较好的平衡。",
)
BLANK = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


class Translator(Protocol):
    """The port of a remote model: one text in, one text out, errors raised."""

    def translate(self, source: str) -> str: ...


def mock_translation(source):
    """Whole sentences, from one that a hash of the trimmed source gives, up to about half its length; no remote call.

    Blank sources give "", null gives null. Lengths are in UTF-16 units, as the hash.
    """
    own = F.regexp_replace(source, rf"\A{BLANK}+|{BLANK}+\z", "")
    table, count = F.array(*map(F.lit, SENTENCES)), F.lit(len(SENTENCES)).cast("long")
    start = F.pmod(F.conv(F.substring(X.fnv1a(own), 9, 8), 16, 10).cast("long"), count)
    units = F.octet_length(F.encode(own, "UTF-16BE")) / 2
    target = F.greatest(F.lit(18.0), F.floor(units * 0.5 + 0.5).cast("double"))
    # what stays the same is in the state, so that it is computed once
    state = lambda text, more, at, size: F.struct(text.alias("text"), more.alias("more"), at.alias("at"), size.alias("size"))

    def add(s, i):
        following = F.element_at(table, (F.pmod(s["at"] + i, count) + 1).cast("int"))
        over = (F.length(s["text"]) > 0) & (F.length(s["text"]) + F.length(following) > s["size"] * 1.15)
        text = F.when(s["more"] & ~over, F.concat(s["text"], following)).otherwise(s["text"])
        return state(text, s["more"] & ~over & (F.length(text) < s["size"]), s["at"], s["size"])

    out = F.aggregate(F.sequence(F.lit(0), F.lit(len(SENTENCES) - 1)), state(F.lit(""), F.lit(True), start, target), add, lambda s: s["text"])
    return F.when(F.length(own) > 0, out).when(F.length(own) == 0, "")


def previewed(target: Column, stand_in: Column, is_tail: Column) -> Column:
    """What a block shows: its translation, else a stand-in; a tail that the next page takes over shows none."""
    return F.when(~F.coalesce(is_tail, F.lit(False)), F.coalesce(target, stand_in))


def split_by_cache(requests: DataFrame, cache: DataFrame, **key: object) -> DataFrame:
    """Requests with their cache key and, where the cache has it, the text; of a key that is there several times one."""
    keyed = requests.withColumn("key", X.cache_key(text=F.col("source"), **key))
    return keyed.join(cache.groupBy("key").agg(F.min("text").alias("cached")), "key", "left")


def run_summary(statuses: DataFrame) -> DataFrame:
    n = F.count("*")
    some = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0))
    out = statuses.agg(n.alias("total"), some("done").alias("done"), some("cached").alias("cached"), some("failed").alias("failed"), some("cancelled").alias("cancelled"))
    return out.withColumn("hit_rate", F.when(F.col("total") > 0, F.round(F.col("cached") / F.col("total"), 6)).otherwise(0.0))


def wait_ms(ident: object, attempt: int, retry_after_ms: float | None, base_ms: float) -> float:
    """The wait after a failed attempt: what the error asks for, else doubling from the base, by a factor from 0.5 to 1
    that the request and the attempt give, so that a retried task waits alike."""
    if retry_after_ms is not None:
        return retry_after_ms
    return base_ms * 2 ** (attempt - 1) * (0.5 + crc32(f"{ident}|{attempt}".encode()) / 2**33)
