"""``python -m twigmer``."""

import sys

from twigmer.plans.build import main

sys.exit(main())
