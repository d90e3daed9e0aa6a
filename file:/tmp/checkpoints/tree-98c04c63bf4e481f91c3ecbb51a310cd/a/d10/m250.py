x250