x662