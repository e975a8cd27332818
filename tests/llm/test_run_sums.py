import numpy as np

from gridspark.llm import decontaminate as D


class Read(np.ndarray):
    """An array that counts the rows taken from it."""

    n = 0

    def take(self, at, *args, **kwargs):
        Read.n += np.size(at)
        return super().take(at, *args, **kwargs)

    def __getitem__(self, at):
        Read.n += np.size(at)
        return super().__getitem__(at)


def test_run_sums_read_each_row_once():
    """A run far shorter than a group doesn't cost a whole group."""
    rng = np.random.default_rng(3)
    lengths = np.concatenate([np.ones(5000, dtype=int), rng.integers(1, 300, 40)])
    rows, vectors = rng.integers(0, 900, lengths.sum()), rng.integers(0, 99, (900, 5)).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    Read.n = 0
    got = np.asarray(D.run_sums(vectors.view(Read), rows, starts, D.GROUP))
    assert Read.n == len(rows)
    assert (got == np.add.reduceat(vectors[rows], starts, axis=0)).all()
