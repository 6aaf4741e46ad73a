import sys

from .frontend import main

sys.exit(main(sys.argv[1:]))
