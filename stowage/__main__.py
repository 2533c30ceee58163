import sys

from stowage.cli import main

sys.exit(main())
