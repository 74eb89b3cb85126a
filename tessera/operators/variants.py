"""Treatment-line variants: eras from segments, overlaps resolved, paths counted.

Overlap resolution repeats over sorted neighbours until nothing overlaps, which no window
function expresses, so each instance's eras go through one vectorised group function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.intervals import DAY_MS
from tessera.operators.rollups import nearest_rank, pareto
from tessera.session import ship

Era = tuple[str, int, int]  # stage, start, end


def _split(a: Era, b: Era, window: float) -> list[Era]:
    """Pieces of two eras where b starts inside a: a alone, both, then what lasts longer."""
    (sa, a0, a1), (sb, b0, b1) = a, b
    low = min(a1, b1)
    both = "+".join(sorted({*sa.split("+"), *sb.split("+")})) if low - b0 >= window else sb
    pieces = [(sa, a0, b0), (both, b0, low), (sb if b1 > a1 else sa, low, max(a1, b1))]
    return [p for p in pieces if p[2] > p[1]]


def resolve_overlaps(eras: list[Era], window: float) -> list[Era]:
    """No era starts inside another any more; long overlaps become combined stages, short ones the incoming stage.

    Passes over eras sorted by start (stable); a pair that overlaps is replaced by its pieces and
    the walk goes on behind the pair. At most one pass more than there are eras.
    """
    for _ in range(len(eras) + 1):
        todo, out, found = sorted(eras, key=lambda e: e[1]), [], False
        while todo:
            if len(todo) > 1 and todo[1][1] < todo[0][2]:
                out += _split(todo[0], todo[1], window)
                del todo[:2]
                found = True
            else:
                out.append(todo.pop(0))
        eras = out
        if not found:
            break
    return eras


def _runs(eras: list[Era], gap: float | None) -> list[Era]:
    """Neighbours of one stage merged; with ``gap``, only those at most so far apart."""
    out: list[Era] = []
    for e in eras:
        if out and out[-1][0] == e[0] and (gap is None or e[1] - out[-1][2] <= gap):
            out[-1] = (e[0], out[-1][1], max(out[-1][2], e[2]))
        else:
            out.append(e)
    return out


def path(segments: list[Era], least: float, gap: float, window: float, stub: float, mode: str, most: int) -> list[Era]:
    """The eras of one instance. ``mode``: all, changes (runs of a stage once) or first (each stage once)."""
    eras = [e for e in sorted(segments, key=lambda e: e[1]) if e[2] - e[1] >= least]
    eras = resolve_overlaps(_runs(eras, gap), window)
    eras = [e for e in eras if "+" in e[0] or e[2] - e[1] >= stub]
    if mode == "changes":
        eras = _runs(eras, None)
    elif mode == "first":
        firsts: dict[str, Era] = {}
        for e in eras:
            firsts.setdefault(e[0], e)
        eras = list(firsts.values())
    return eras[: max(1, most)]


def variants(segments: DataFrame, key: str, as_of_ms: int, least_days: float = 0.0, gap_days: float = 30.0, window_days: float = 30.0, stub_days: float = 0.0, mode: str = "changes", most: int = 5) -> DataFrame:
    """key, variant (stages joined by ``-``), starts and ends of its eras; an instance without eras has an empty variant."""
    kind = segments.schema[key].dataType.simpleString()
    least, gap, window, stub = (d * DAY_MS for d in (least_days, gap_days, window_days, stub_days))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ms", "end_ms", "stage"], kind="stable")
        eras = path(list(zip(pdf["stage"], pdf["start_ms"].tolist(), pdf["end_ms"].tolist())), least, gap, window, stub, mode, most)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "variant": ["-".join(e[0] for e in eras)], "starts": [[e[1] for e in eras]], "ends": [[e[2] for e in eras]]})

    ship(segments.sparkSession)
    rows = segments.select(key, "stage", "start_ms", F.coalesce("end_ms", F.lit(as_of_ms)).alias("end_ms"))
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, variant string, starts array<long>, ends array<long>")


def variant_table(found: DataFrame, top: int | None = None) -> DataFrame:
    """Variants by falling count with shares and the nearest-rank median of their overall days."""
    days = (F.element_at("ends", -1) - F.element_at("starts", 1)) / DAY_MS
    n = found.where("variant != ''").withColumn("__d", days).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), nearest_rank("__d", 0.5).alias("median_days"))
    return pareto(n, "variant", top=top).join(n.select("variant", F.round("median_days", 6).alias("median_days")), "variant")
