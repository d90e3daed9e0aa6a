x687