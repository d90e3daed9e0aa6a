x676