x461