"""``python -m cellmosaic``."""

from cellmosaic.plans.run import main

if __name__ == "__main__":
    main()
