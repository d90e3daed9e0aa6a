x217