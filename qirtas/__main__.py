import sys

if sys.argv[1:2] == ["crawl"]:
    from .plans.crawl import main

    sys.exit(main(sys.argv[2:]))
from .plans.engines import main

sys.exit(main())
