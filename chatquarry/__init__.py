"""An engine that curates and scores corpora of chat-style reasoning data.

Functions that run on executors are sent with their code, so a cluster's workers need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
