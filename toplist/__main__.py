import sys

from toplist.cli import main

sys.exit(main())
