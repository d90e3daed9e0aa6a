x842