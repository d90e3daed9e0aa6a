x980