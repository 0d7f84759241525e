"""Print the query names of the given catalog modules."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from mnemora import catalog  # noqa: E402

wanted = {f"mnemora.catalog.{m}" for m in sys.argv[1:]}
print(" ".join(n for n, f in catalog.queries().items() if f.__module__ in wanted))
