import sys

from touchline.cli import main

sys.exit(main())
