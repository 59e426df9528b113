"""How many of the pairs that all-pairs Jaccard finds in a whole table are in one group of the near-dedup stage."""

from collections import defaultdict

from corvane.llm import wide_simhash
from corvane.llm.common import table

SF = "/root/testdata/sf0.01"


def similar_pairs(texts: list[str]) -> list[tuple[int, int]]:
    """All pairs at a Jaccard similarity of 0.8 or more of their sets of five-word shingles, by the shingles they share."""
    sets = [frozenset(wide_simhash.shingle_set((t or "").encode()).tolist()) for t in texts]
    holders, out = defaultdict(list), []
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in holders[x]:
                both[j] += 1
            holders[x].append(i)
        out += [(j, i) for j, n in both.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
    return out


def test_recall_of_groups(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    pairs = similar_pairs([r.text for r in rows])
    groups = {r.doc_id: r.keep_id for r in wide_simhash.near_duplicate_ids(table(spark, SF, "documents")).collect()}
    found = sum(groups[rows[a].doc_id] == groups[rows[b].doc_id] for a, b in pairs)
    print(f"{found} of {len(pairs)} pairs")
    assert len(pairs) > 50 and found >= 0.95 * len(pairs)
