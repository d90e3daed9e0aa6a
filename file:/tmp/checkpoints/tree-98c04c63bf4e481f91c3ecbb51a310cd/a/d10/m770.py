x770