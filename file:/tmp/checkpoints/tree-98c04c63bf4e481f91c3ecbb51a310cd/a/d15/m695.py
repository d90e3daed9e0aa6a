x695