x482