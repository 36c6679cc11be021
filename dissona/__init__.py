"""dissona: contradiction analytics on Spark DataFrames."""

import os

# small matrices are multiplied here, in as many workers as there are cores: one thread each is fastest
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
