x34