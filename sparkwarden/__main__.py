import sys

from sparkwarden.plans.cli import main

sys.exit(main())
