x523