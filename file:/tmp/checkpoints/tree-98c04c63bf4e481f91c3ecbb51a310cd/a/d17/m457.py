x457