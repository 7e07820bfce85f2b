"""python -m tests.llm.measure_similar SF_DIR...: the near-duplicate stage against all pairs of similarity 0.8 or more.

The pairs are found by another way, exact for any similarity: sets of similarity 0.8 share one of the n - ceil(0.8 n) + 1 rarest shingles of either.
Prints the pairs, those whose texts the stage puts in one group, and whether its groups are exactly those that the pairs make.
"""

import glob
import sys

import numpy as np
import pyarrow.dataset as ds

from strandloom.llm import simhash
from strandloom.llm.components import contracted
from strandloom.session import local_session


def similar_pairs(sets):
    every = np.concatenate(sets)
    hashes, number, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(hashes), dtype=np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(hashes))
    begin = np.cumsum([0, *map(len, sets)])
    owner, token = [], []
    for i, s in enumerate(sets):
        rarest = np.sort(rank[number[begin[i] : begin[i + 1]]])[: len(s) - (4 * len(s) + 4) // 5 + 1]
        owner.append(np.full(len(rarest), i))
        token.append(rarest)
    owner, token = np.concatenate(owner), np.concatenate(token)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    edges = np.flatnonzero(np.diff(token, prepend=-1))
    seen, pairs = set(), []
    for at, stop in zip(edges, np.append(edges[1:], len(token)), strict=True):
        if stop - at > 1:
            some = np.unique(owner[at:stop]).tolist()
            for x, i in enumerate(some):
                for j in some[x + 1 :]:
                    if (i, j) not in seen:
                        seen.add((i, j))
                        n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                            pairs.append((i, j))
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


def main():
    spark = local_session(8, 16)
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir("/tmp/measure-similar")
    for sf_dir in sys.argv[1:]:
        texts = ds.dataset(glob.glob(f"{sf_dir}/documents.parquet/*.parquet") or f"{sf_dir}/documents.parquet").to_table(columns=["doc_id", "text"])
        ids, sets = texts["doc_id"].to_numpy(), [simhash.shingle_set(t or "") for t in texts["text"].to_pylist()]
        same = {}
        of = np.array([same.setdefault(s.tobytes(), len(same)) for s in sets])
        first = np.unique(of, return_index=True)[1]
        pairs = similar_pairs([sets[i] for i in first if len(sets[i])])
        full = np.array([k for k, i in enumerate(first) if len(sets[i])])
        pairs = full[pairs]
        want = contracted(len(first), pairs[:, 0], pairs[:, 1])[of]
        found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
        got = np.array([found[i] for i in ids.tolist()])
        caught = (got[first[pairs[:, 0]]] == got[first[pairs[:, 1]]]).sum()
        groups = len(set(zip(want.tolist(), got.tolist(), strict=True))) == len(set(want.tolist())) == len(set(got.tolist()))
        print(f"{sf_dir}: {len(ids)} rows, {len(first)} different sets, {len(pairs)} pairs of similarity 0.8 or more, {caught} in one group; groups exactly those of the pairs: {groups}", flush=True)


if __name__ == "__main__":
    main()
