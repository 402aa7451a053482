"""A fitted random forest as tables of bits, so that batches of rows are predicted in numpy, to the same classes as Spark's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel

#: Bits of a mask, a leaf of a tree each, up to which there are numpy types.
WIDTHS = (8, 16, 32, 64)


class Forest:
    """A tree's leaves are numbered from the left. A value of a feature falls between two of the forest's thresholds on
    it, its bin; masks[feature][bin, tree] has the leaves that a row with it may still reach. The lowest bit that all of
    a row's masks share is its leaf, and the class is that of the largest sum of the leaves' shares, tree by tree.
    """

    def __init__(self, model: RandomForestClassificationModel):
        trees = [_nodes(t._call_java("rootNode")) for t in model.trees]
        leaves = max(len(stats) for _, stats in trees)
        width = next(w for w in WIDTHS if w >= leaves)
        self.bits, n = np.dtype(f"u{width // 8}"), model.numFeatures
        self.thresholds = [np.array(sorted({x for splits, _ in trees for f, x, _ in splits if f == k})) for k in range(n)]
        self.masks = [np.full((len(t) + 1, len(trees)), ~self.bits.type(0)) for t in self.thresholds]
        self.votes = np.zeros((len(trees), leaves, model.numClasses))
        for k, (splits, stats) in enumerate(trees):
            for f, x, left in splits:
                self.masks[f][np.searchsorted(self.thresholds[f], x) + 1 :, k] &= ~self.bits.type(left)
            for leaf, counts in enumerate(stats):
                total = sum(counts)
                if total:
                    self.votes[k, leaf] = np.array(counts) / total

    def bins(self, feature: int, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.thresholds[feature], values)

    def classes(self, masks: np.ndarray) -> np.ndarray:
        """The class of each row of masks, a column a tree. Shares are summed in the trees' order, as Spark does."""
        leaf = np.ascontiguousarray(np.bitwise_count((masks & (~masks + self.bits.type(1))) - self.bits.type(1)).T)
        sums = np.zeros((len(masks), self.votes.shape[2]))
        for votes, own in zip(self.votes, leaf, strict=True):
            sums += votes.take(own, axis=0)
        return sums.argmax(axis=1)

    def moved(self, columns: list[np.ndarray], shifts: list[int]) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """feature, number of the shift from 1 on, and the rows' classes where the feature's values come from rows so
        many places on; first None, 0 and the classes of the rows as they are.

        Only pairs of a row and a bin that it does not lie in are predicted, each once, and of their masks only the
        moved feature's is new.
        """
        rows, bins = np.arange(len(columns[0])), [self.bins(f, c) for f, c in enumerate(columns)]
        own = [m[b] for m, b in zip(self.masks, bins, strict=True)]
        after = [np.full_like(own[0], ~self.bits.type(0))]
        for x in own[:0:-1]:
            after.append(after[-1] & x)
        before = np.full_like(own[0], ~self.bits.type(0))
        whole = self.classes(after[-1] & own[0])
        yield None, 0, whole
        for f, masks in enumerate(self.masks):
            others = before & after.pop()
            taken = [np.roll(bins[f], -s) for s in shifts]
            wanted = np.zeros((len(rows), len(masks)), bool)
            for b in taken:
                wanted[rows, b] = True
            wanted[rows, bins[f]] = False
            found = np.repeat(whole[:, None], len(masks), axis=1)
            at, b = wanted.nonzero()
            found[at, b] = self.classes(others[at] & masks[b])
            for k, b in enumerate(taken):
                yield f, k + 1, found[rows, b]
            before &= own[f]


def _nodes(root) -> tuple[list[tuple[int, float, int]], list[list[float]]]:
    """The splits of a tree as feature, threshold and the bits of the leaves on the left, and its leaves' counts by class."""
    splits, leaves = [], []

    def bits(node) -> int:
        if not node.subtreeDepth():
            leaves.append(list(node.impurityStats().stats()))
            return 1 << len(leaves) - 1
        split, left = node.split(), bits(node.leftChild())
        splits.append((split.featureIndex(), split.threshold(), left))
        return left | bits(node.rightChild())

    bits(root)
    return splits, leaves
