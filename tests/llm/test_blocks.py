import numpy as np

from sparsefold.llm import jaccard


def chained(n: int, length: int, seed: int = 3) -> list[list[int]]:
    """Sets that share two tokens with the next one, every tenth followed by a near copy; and a group of sets just under the threshold of each other."""
    rng = np.random.default_rng(seed)
    sets = []
    for i in range(n):
        own = rng.integers(1, 1 << 60, length).tolist()
        sets.append(sets[-1][:2] + own if sets else own)
        if i % 10 == 0:
            sets.append(sets[-1][:-3] + rng.integers(1, 1 << 60, 2).tolist())
    shared = rng.integers(1, 1 << 60, length).tolist()
    sets += [shared + rng.integers(1, 1 << 60, k).tolist() for k in rng.integers(1, length // 3, 40).tolist()]
    return [sorted(set(s)) for s in sets + [[1, 2], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [2, 3]]]


def closure(n: int, pairs) -> list[int]:
    at = list(range(n))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return [root(i) for i in range(n)]


def test_large_block_of_unlike_sets_meets_by_rare_tokens(spark, monkeypatch):
    sets, seen, save = chained(300, 60), {}, jaccard.save

    def counted(df, name):
        out = save(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "save", counted)
    members = save(spark.createDataFrame([(i, 0, s) for i, s in enumerate(sets)], "id long, block long, tokens array<long>"), "members")
    for percent in (80, 90):
        got = [tuple(r) for r in jaccard.links(members, percent, 8).collect()]
        like = lambda a, b: 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))
        every = [(i, j) for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j])]
        assert all(like(sets[a], sets[b]) for a, b in got)
        assert closure(len(sets), got) == closure(len(sets), every)
        assert len(every) > 30
        # all pairs of leaves would take each of the 374 sets to some 40 units
        assert seen["units"] < 2 * len(sets)
