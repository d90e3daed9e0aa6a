x698