from quire.cli import main

raise SystemExit(main())
