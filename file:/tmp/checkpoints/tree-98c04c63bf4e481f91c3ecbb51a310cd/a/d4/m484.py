x484