from codeweave.cli import main

raise SystemExit(main())
