"""Training-data operators: one module per operator, a thin query for each in ``catalog``.

quality   (1) distribution divergence          simhash  (2) covering-LSH near-dedup
packing   (3) conflict-constrained best fit    secrets  (4) sliding-window entropy scan
langid    (5) cross-parsing entropy            mixing   (6) multinomial block mixing
topk      (7) exact inner-product search       lm       (8) cross-entropy difference
suffix    (9) longest-previous-factor dedup    sharding (10) balanced label propagation
pstable  (11) p-stable near-dedup of vectors   clusters (13) equal-average equal-variance clustering
prefixtrie (12) conversation trie by van Emde Boas recursion

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Python tasks carry the code of this subpackage with them: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
