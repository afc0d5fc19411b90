"""Splitting oversized items at natural boundaries, by pointer doubling.

Every boundary of every item points to its farthest legal successor: the last
boundary that a piece beginning ``overlap`` before it can still reach. Squaring
the successor table again and again (a jump, two jumps, four jumps, ...) spreads
the set of boundaries reached from the items' beginnings, so that all greedy
cuts of all items at hand are known after as many rounds as the logarithm of
the largest number of pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 524_288, 16_384


def greedy_cuts(item, size, limit: int, overlap: int):
    """Pieces of items given by the sizes of their parts, as (item, piece_no, begin, end, at_border) arrays.

    ``item``: number of the item of each part, ascending from 0; ``size``: of
    the parts, 0 or more. A piece ends at the last border that lies within the
    limit and leaves the next piece a later beginning; where there is none, it
    has the full limit and is cut within a part.
    """
    import numpy as np

    none = np.empty(0, np.int64)
    if not len(item):
        return none, none, none, none, none.astype(bool)
    stride, n = limit - overlap, int(item[-1]) + 1
    total = np.zeros(n, np.int64)
    np.add.at(total, item, size)
    # One axis for all items, far enough apart for no piece to reach the next; each item's start stands where a previous piece would have ended.
    base = np.concatenate(([0], np.cumsum(total + limit + 1)[:-1]))
    end = np.cumsum(size) - np.concatenate(([0], np.cumsum(total)[:-1]))[item]
    keep = (size > 0) & ((end > overlap) | (end == total[item]))
    borders_item, borders = item[keep], end[keep]
    owner = np.concatenate((np.arange(n), borders_item))
    at = np.concatenate((np.full(n, overlap), borders))
    start = np.concatenate((np.ones(n, bool), np.zeros(len(borders), bool)))
    order = np.lexsort((at, ~start, owner))
    owner, at, start = owner[order], at[order], start[order]
    lastof = np.searchsorted(owner, np.arange(n), "right") - 1
    line = base[owner] + np.maximum(at, overlap)
    me = np.arange(len(at))
    whole = total[owner] <= limit

    reach = np.searchsorted(line, line + stride, "right") - 1
    reach = np.minimum(reach, lastof[owner])
    hard = np.zeros(len(at), np.int64)
    stuck = (reach <= me) & (me < lastof[owner])
    nxt = np.minimum(me + 1, len(at) - 1)
    hard[stuck] = -(-(at[nxt] - at)[stuck] // stride) - 1
    far = np.minimum(np.searchsorted(line, line + (hard + 1) * stride, "right") - 1, lastof[owner])
    succ = np.where(me == lastof[owner], me, np.where(start & whole, lastof[owner], far))
    hard[start & whole] = 0

    reached, jump = start.copy(), succ
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]

    here = np.flatnonzero(reached & (succ != me))
    times = hard[here] + 1
    row = np.repeat(here, times)
    k = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    closing = k == hard[row]
    stop = np.where(closing, at[succ[row]], at[row] + (k + 1) * stride)
    begin = at[row] + k * stride - overlap
    number = np.arange(len(row)) - np.searchsorted(owner[row], owner[row], "left") + 1
    return owner[row], number, begin, stop, closing


def split_parts(parts: DataFrame, id_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Cuts items given as rows of (id, pos, size); (id, pos) occurring again counts once, a null size as 0.

    Rows are exchanged by item and sorted; each task then reads them as a flat
    stream. An item is held by one task, in 16 bytes a part; where parts come
    out of one array cell, as with :func:`split_entries`, that is bounded by
    what a cell can hold.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    schema = "id bigint, piece_no int, piece_begin bigint, piece_end bigint, at_border boolean"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def cut(ids, pos, size):
            once = np.concatenate(([True], (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])))
            ids, size = ids[once], size[once]
            new = np.concatenate(([True], ids[1:] != ids[:-1]))
            own, number, begin, end, border = greedy_cuts(np.cumsum(new) - 1, size, limit, overlap)
            return pa.RecordBatch.from_arrays([pa.array(ids[new][own]), pa.array(number.astype(np.int32)), pa.array(begin), pa.array(end), pa.array(border)], ["id", "piece_no", "piece_begin", "piece_end", "at_border"])

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, pos, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            first = int(np.searchsorted(ids, ids[-1], "left"))
            if first or (held and held[0][0][0] != ids[-1]):
                done = [np.concatenate(x) for x in zip(*held, (ids[:first], pos[:first], size[:first]))]
                yield cut(*done)
                held = []
            held.append((ids[first:], pos[first:], size[first:]))
        if held:
            yield cut(*(np.concatenate(x) for x in zip(*held)))

    rows = parts.select(F.col(id_col).cast("bigint").alias("id"), F.col("pos").cast("bigint").alias("pos"), F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"))
    rows = rows.filter(F.col("id").isNotNull()).repartition("id").sortWithinPartitions("id", "pos")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def split_entries(entries: DataFrame, fragments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of each entry's content: entry_id, piece_no, piece_begin, piece_end, at_border.

    The content is what dt_ptr names, in order; a fragment named twice counts
    twice, pointers to no row or to an unknown size (null or negative) add
    nothing. Entries without content (null or empty dt_ptr, or no known size)
    have no pieces.
    """
    pointers = entries.select("entry_id", F.posexplode("dt_ptr").alias("pos", "frag_id"))
    sizes = fragments.filter("ht_usize > 0 and frag_id is not null").select("frag_id", F.col("ht_usize").alias("size"))
    return split_parts(pointers.join(sizes, "frag_id").select("entry_id", "pos", "size"), "entry_id", limit, overlap)
