x157