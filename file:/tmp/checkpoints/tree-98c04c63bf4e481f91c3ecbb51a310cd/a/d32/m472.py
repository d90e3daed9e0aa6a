x472