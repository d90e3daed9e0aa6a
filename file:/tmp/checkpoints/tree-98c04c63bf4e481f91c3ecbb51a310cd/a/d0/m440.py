x440