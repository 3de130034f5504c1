from weftline.model import Declared, Entity, Field, Reference

SHOP = Declared([Entity("Customer", (Field("ID", primary_key=True),)), Entity("Order", (), (Reference(("CustomerID",), "Customer"),))])
