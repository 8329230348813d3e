"""Mixing schedules by walking through every slot."""

from pyspark.sql import functions as F

from stowage.llm import mixing
from stowage.llm.common import table


def brute_schedule(ids_by_source, weights):
    """(slot, place) of every id, one slot after another: the earliest deadline among the released blocks; a phase ends where a source has no block."""
    n = mixing.BLOCK_ROWS
    blocks = {s: [ids[i : i + n] for i in range(0, len(ids), n)] for s, ids in ids_by_source.items()}
    out, slot = {}, 0
    while blocks:
        share = mixing.whole_weights({s: weights[s] for s in blocks})
        total, t, had = sum(share.values()), 0, dict.fromkeys(blocks, 0)
        while True:
            s = min((s for s in blocks if had[s] * total // share[s] <= t), key=lambda s: (-(-(had[s] + 1) * total // share[s]), repr(s)))
            if had[s] == len(blocks[s]):
                break
            out |= {i: (slot, place) for place, i in enumerate(blocks[s][had[s]])}
            had[s], t, slot = had[s] + 1, t + 1, slot + 1
        blocks = {s: left[had[s] :] for s, left in blocks.items() if len(left) > had[s]}
    return out


def brute_schedule_of(spark, sf, ids):
    """(slot, place) of these documents, mixed to tempered weights."""
    rows = table(spark, sf, "documents").select("doc_id", "source", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()
    by_source = {}
    for r in sorted((r for r in rows if r.doc_id in ids), key=lambda r: (r.h % 2**64 >> 54, r.h, r.doc_id)):
        by_source.setdefault(r.source, []).append(r.doc_id)
    assert len(by_source) > 1
    return brute_schedule(by_source, mixing.tempered({s: len(ids) for s, ids in by_source.items()}))
