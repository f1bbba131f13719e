import sys

from gavel.cli import main

sys.exit(main())
