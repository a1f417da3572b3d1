"""bytegram: exact substring counting, locating and retrieval over document corpora, on Spark."""
from .plans.corpus import Corpus  # noqa: F401
from .session import checkpoint_root, local_session  # noqa: F401
