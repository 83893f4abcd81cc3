import tracemalloc

import numpy as np

from proofmill.operators import matching


def test_memory_of_a_group():
    """A full group's scores aren't held at once: some MB besides its vectors. The best of each crop is that of all windows."""
    rng = np.random.default_rng(2)
    crops, templates = list(rng.normal(size=(1500, 64))), list(rng.normal(size=(1500, 62)))
    tracemalloc.start()
    found = matching.best_in_group(crops, templates, (1.0,), 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    t = np.array([(x - x.mean()) / np.linalg.norm(x - x.mean()) for x in templates])
    for k in range(0, 1500, 300):
        windows = [crops[k][at : at + 62] for at in range(3)]
        scores = np.array([t @ (w - w.mean()) / np.linalg.norm(w - w.mean()) for w in windows])
        assert abs(found[k][0] - scores.max()) < 1e-12
        assert (found[k][3], found[k][1]) == np.unravel_index(scores.argmax(), scores.shape)
    assert matching.GROUP_VALUES <= 1 << 17
