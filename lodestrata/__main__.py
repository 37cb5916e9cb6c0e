"""``python -m lodestrata FILE``: run a pipeline file."""

import sys

from .plans.runner import main

sys.exit(main())
