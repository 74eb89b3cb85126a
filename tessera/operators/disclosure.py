"""Small-cell suppression, masking and tamper evidence."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.session import ship

FLOOR = 5


def small(n: Column | str, floor: int = FLOOR) -> Column:
    """Primary rule of a single figure: above zero and below the floor, which can only be raised."""
    n = F.col(n) if isinstance(n, str) else n
    return (n > 0) & (n < max(floor, FLOOR))


def choose_suppressed(counts: list[int], partitions: list[list[int]], floor: int = FLOOR) -> set[int]:
    """Cells of one table to hide: all below the floor, zero too, and the smallest visible cell (the first of equal
    ones) of each partition in which exactly one is hidden, partition by partition in turn until a whole turn adds none.

    Each partition keeps the number of its hidden cells, so a turn costs what it hides.
    """
    owners: dict[int, list[int]] = {}
    for p, cells in enumerate(partitions):
        for i in cells:
            owners.setdefault(i, []).append(p)
    hidden, n_hidden = set(), [0] * len(partitions)

    def hide(i: int) -> None:
        hidden.add(i)
        for p in owners.get(i, ()):
            n_hidden[p] += 1

    for i, n in enumerate(counts):
        if n < floor:
            hide(i)
    turn, quiet = 0, 0
    while quiet < len(partitions):
        p, turn = turn % len(partitions), turn + 1
        if n_hidden[p] == 1 < len(partitions[p]):
            hide(min((i for i in partitions[p] if i not in hidden), key=counts.__getitem__))
            quiet = 0
        else:
            quiet += 1
    return hidden


def suppress(cells: DataFrame, table: str, row: str, column: str, n: str = "n", floor: int = FLOOR) -> DataFrame:
    """``cells`` with ``suppressed``, over the rows and columns of each published table.

    A published table is small by nature, so one group holds it.
    """
    ship(cells.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([row, column], kind="stable").reset_index(drop=True)
        parts = [list(g.index) for by in (row, column) for _, g in pdf.groupby(by, sort=True)]
        hidden = choose_suppressed(pdf[n].tolist(), parts, floor)
        return pdf.assign(suppressed=[i in hidden for i in range(len(pdf))])

    return cells.groupBy(table).applyInPandas(run, T.StructType([*cells.schema.fields, T.StructField("suppressed", T.BooleanType())]))


def withhold(cells: DataFrame, n: str = "n", remove: bool = False) -> DataFrame:
    """Hidden counts become null with a reason, or their rows go."""
    if remove:
        return cells.where("NOT suppressed").drop("suppressed")
    return cells.withColumns({n: F.when(~F.col("suppressed"), F.col(n)), "reason": F.when(F.col("suppressed"), "small_cell")}).drop("suppressed")


def mask(value: Column | str, keep: int = 4) -> Column:
    """Letters and digits but the last ``keep`` characters become ``*``; separators stay, short values too."""
    v = F.col(value) if isinstance(value, str) else value
    n = F.char_length(v)
    return F.when(n <= keep, v).otherwise(F.concat(F.regexp_replace(F.substring(v, F.lit(1), n - keep), r"[\p{L}\p{N}]", "*"), F.substring(v, n - keep + 1, F.lit(keep))))


def mask_person(df: DataFrame, sensitive: tuple[str, ...] = ("SSN", "TAX"), private: tuple[str, ...] = ("phone", "sms", "fax")) -> DataFrame:
    """Masks tax_id, sensitive identifiers, document numbers and private telecom of a person record, where the columns exist."""
    def element(fields: list[str], kind: str | None, value: str, hit: tuple[str, ...]):
        def masked(x: Column) -> Column:
            hidden = mask(x[value]) if kind is None else F.when(x[kind].isin(list(hit)), mask(x[value])).otherwise(x[value])
            return F.struct(*[(hidden if f == value else x[f]).alias(f) for f in fields])

        return masked

    names = {f.name: f.dataType for f in df.schema.fields}
    out = df.withColumn("tax_id", mask("tax_id")) if "tax_id" in names else df
    for column, kind, value, hit in (("identifiers", "identifier_type", "value", sensitive), ("telecom", "system", "value", private), ("documents", None, "number", ())):
        if column in names:
            out = out.withColumn(column, F.transform(column, element(names[column].elementType.names, kind, value, hit)))
    return out


def active_consent(consents: str, today: Column) -> Column:
    """Some consent is active and doesn't expire before today."""
    return F.coalesce(F.exists(consents, lambda c: (c["status"] == "active") & (c["expires_on"].isNull() | (c["expires_on"] >= today))), F.lit(False))


#: Unit separator between the fields of a digest's preimage.
SEPARATOR = "\x1f"


def row_digest(*columns: str) -> Column:
    """SHA-256 over the fields as text, nulls as empty, each followed by the separator but the last."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"), 256)


def sha3(column: str) -> Column:
    """SHA3-256 of a text, which Spark lacks."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.sha3_256(x.encode()).hexdigest())

    return run(F.col(column))


def keyed_mac(column: str, key: bytes, domain: str) -> Column:
    """HMAC-SHA-256 with a key derived for the domain (HKDF, empty salt)."""
    own = hmac.new(hmac.new(bytes(32), key, "sha256").digest(), domain.encode() + b"\x01", "sha256").digest()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(own, x.encode(), "sha256").hexdigest())

    return run(F.col(column))


def chain(log: DataFrame, key: str, seq: str, fields: list[str], chained: str) -> DataFrame:
    """``log`` with prev_hash and hash: each row's hash covers the hash before it and its own fields.

    Rows whose ``chained`` is false have neither, and the chain of their key starts anew behind
    them. Keys are read in order, with one hash in memory.
    """
    own = F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    names = log.columns

    def run(batches):
        of, last = None, None
        for batch in batches:
            before, after = [], []
            for k, text, kept in zip(*(batch.column(c).to_pylist() for c in (key, "__own", chained))):
                if k != of:
                    of, last = k, None
                before.append(last if kept else None)
                last = hashlib.sha256(f"{last or ''}{SEPARATOR}{text}".encode()).hexdigest() if kept else None
                after.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(before, pa.string()), pa.array(after, pa.string())], [*names, "prev_hash", "hash"])

    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log.withColumn("__own", own).repartition(n, key).sortWithinPartitions(key, seq)
    return rows.mapInArrow(run, T.StructType([*log.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())]))


def verify_chain(log: DataFrame, key: str, seq: str, *fields: str) -> DataFrame:
    """Each row of a hash-chained log with ``linked`` (prev_hash is the hash before it) and ``intact`` (its hash fits its fields).

    Rows without a hash are unchained, and the chain starts anew behind them. ``key`` names
    independent logs, whose chains are verified side by side.
    """
    before = F.lag("hash").over(Window.partitionBy(key).orderBy(seq))
    chained = F.col("hash").isNotNull()
    linked = F.when(chained, F.coalesce(F.col("prev_hash").eqNullSafe(before), F.lit(False)))
    return log.withColumns({"chained": chained, "linked": linked, "intact": F.when(chained, F.col("hash") == row_digest("prev_hash", *fields))})


def chain_summary(verified: DataFrame, key: str, seq: str) -> DataFrame:
    """Counts, the head and whether each log holds: all chained rows linked and intact."""
    return verified.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("chained").alias("n_chained"), F.count_if(~F.col("intact")).alias("n_changed"), F.count_if(~F.col("linked")).alias("n_unlinked"),
        F.max_by("hash", F.when(F.col("chained"), F.col(seq))).alias("head"),
    ).withColumn("holds", (F.col("n_changed") == 0) & (F.col("n_unlinked") == 0))


def checkpoint_holds(log: DataFrame, key: str, seq: str, anchors: DataFrame) -> DataFrame:
    """Whether the log still has each anchor's head (seq, head, n): the hash there and as many rows up to it."""
    a = anchors.select(key, F.col("seq").alias("__s"), "head", "n")
    rows = log.join(a, key).where(F.col(seq) <= F.col("__s"))
    return rows.groupBy(key, "__s", "head", "n").agg(F.max(F.when(F.col(seq) == F.col("__s"), F.col("hash"))).alias("now"), F.count(F.lit(1)).alias("m")).select(key, F.col("__s").alias("seq"), ((F.col("now").eqNullSafe(F.col("head"))) & (F.col("n") == F.col("m"))).alias("holds"))


def erase(log: DataFrame, condition: Column, fields: list[str], tombstone: str = "[erased]") -> DataFrame:
    """Rows that match lose the named fields' content but keep their hashes, so the chain still links."""
    return log.withColumns({f: F.when(condition, F.lit(tombstone)).otherwise(F.col(f)) for f in fields} | {"redacted": F.coalesce(condition, F.lit(False))})


def commitment(salt: Column, address: Column) -> Column:
    """Salted SHA-256 of an address, each part followed by the separator, under a fixed label."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit("audit-address"), salt, address, F.lit("")).cast("binary"), 256)


def record_digest(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of the record as JSON with its keys in order; nulls are written."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def disclosures(log: DataFrame, since: str, until: str) -> DataFrame:
    """The rows of an audit log that say what was handed on, from one day and before another."""
    return log.where((F.col("action") == "disclosed") & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))


def rate_limited(attempts: DataFrame, key: str, at: str, tie: str, most: int, window: int) -> DataFrame:
    """``attempts`` with ``allowed``: fewer than ``most`` allowed ones of the key lie in the ``window`` seconds before.

    A refused attempt isn't counted, so what is allowed depends on what was, and keys are read
    in order; memory holds ``most`` times of one key.
    """
    names = attempts.columns

    def run(batches):
        of, recent = None, []
        for batch in batches:
            out = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(at).to_pylist()):
                if k != of:
                    of, recent = k, []
                recent = [x for x in recent if x > t - window]
                out.append(len(recent) < most)
                if out[-1]:
                    recent.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*names, "allowed"])

    n = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = attempts.repartition(n, key).sortWithinPartitions(key, at, tie)
    return rows.mapInArrow(run, T.StructType([*attempts.schema.fields, T.StructField("allowed", T.BooleanType())]))
