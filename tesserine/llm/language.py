"""Language identification by compression.

Each language has raw-content zstandard dictionaries of its own training text. A text belongs to the language whose dictionary encodes it in the fewest
bytes; where the runner-up needs nearly as few, the verdict is rejected. Both sides are folded first: lower case, ASCII digits and symbols as spaces, spaces joined.
Texts below ``SHORT`` bytes, whose sizes tell too little in whole bytes, are encoded with several smaller dictionaries per language at a higher level and the sizes added.

The dictionaries are fitted on a bounded sample: of each language, the ``sample`` training rows whose ids hash lowest, ``PREFIX`` characters of each, at most
``POOL`` bytes. Every text to be judged is encoded whole.

Defined cases: null text or one without a letter is ``und`` with score 0, as is every text where nothing could be learned; equal sizes go to the language with more
training rows, then to the first by name, with score 0; repeated rows are judged alike; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.llm.workers import release

#: Bytes of training text of a language, and of its large and small dictionaries.
POOL, LARGE, SMALL = 1 << 18, 1 << 17, 1 << 15
#: Characters taken of a training row.
PREFIX = 400
#: Folded texts below so many bytes use the small dictionaries.
SHORT = 400
LEVEL, SHORT_LEVEL = 5, 12
#: Bytes encoded at a time, so that a very long text needs no more memory.
PART = 1 << 18
UNKNOWN = "und"
_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def fold(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def learn(rows: DataFrame, sample: int = 2000) -> list[tuple[str, bytes]]:
    """Dictionaries from (doc_id, text, lang); languages with more rows first. Bounded by ``POOL`` bytes a language."""
    labelled = rows.select("doc_id", F.substring("text", 1, PREFIX).alias("text"), "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    frequency = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # about four times the sample passes this cut, whatever the number of rows, so that is all that is ranked
    space = 1 << 32
    cut = F.lit(space)
    for lang, n in frequency.items():
        cut = F.when(F.col("lang") == lang, min(space, 4 * sample * space // n)).otherwise(cut)
    hashed = labelled.withColumn("_h", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(space))).where(F.col("_h") < cut)
    by_hash = W.partitionBy("lang").orderBy("_h", "text")
    taken = hashed.withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= sample).select("lang", "_n", "text").collect()
    texts: dict[str, dict[bytes, None]] = defaultdict(dict)
    for r in sorted(taken, key=lambda r: (r.lang, r._n)):
        texts[r.lang][fold(r.text)] = None
    pools = {lang: b" ".join(t)[:POOL].ljust(64) for lang, t in texts.items()}
    return sorted(pools.items(), key=lambda p: (-frequency[p[0]], p[0]))


class Classifier:
    def __init__(self, pools: list[tuple[str, bytes]]):
        import zstandard

        def encoder(content: bytes, level: int):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.names = [name for name, _ in pools]
        self.large = [[encoder(pool[:LARGE], LEVEL)] for _, pool in pools]
        self.small = [[encoder(pool[i:i + SMALL], SHORT_LEVEL) for i in range(0, len(pool), SMALL) if i == 0 or len(pool) - i >= 8] for _, pool in pools]

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, relative margin to the runner-up)."""
        folded = fold(text) if text else b""
        if not self.names or not folded or folded.isascii() is False and not any(map(str.isalpha, folded.decode())):
            return UNKNOWN, 0.0
        encoders = self.small if len(folded) < SHORT else self.large
        sizes = [sum(len(e.compress(folded[i:i + PART])) for i in range(0, len(folded), PART) for e in es) / len(es) for es in encoders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.names[best], 1 - sizes[best] / second


def identify(docs: DataFrame, pools: list[tuple[str, bytes]], min_margin: float = 0.002, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected (no letter, or a margin below ``min_margin``) to the columns ``keep`` (all, if not given)."""
    shared = docs.sparkSession.sparkContext.broadcast(pools)  # at most POOL bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        judge = Classifier(shared.value)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                       pa.array([f[0] == UNKNOWN or f[1] < min_margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string, score double, rejected boolean"])
    return rows.mapInArrow(run, types)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0
