x183