x75