x486