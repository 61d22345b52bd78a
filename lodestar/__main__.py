from lodestar.cli import main

raise SystemExit(main())
