"""python -m alphaloom <command>."""

import sys

from .commands import main

sys.exit(main())
