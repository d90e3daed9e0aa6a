x540