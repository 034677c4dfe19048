"""Training-data operators on document and embedding tables; nothing else in the library imports this.

What tasks need of this package travels with them, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
