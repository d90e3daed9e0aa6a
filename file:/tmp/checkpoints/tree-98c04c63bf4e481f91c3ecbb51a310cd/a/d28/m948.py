x948